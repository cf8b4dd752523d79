"""Chunked encoding against encoding each text whole."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import encode

ALPHABET = st.sampled_from(list("ab 1'.-\n\t é漢字😀́​ß") + ["  ", "\r\n", "'s", "don't", " the", "aaaa"])


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join), st.lists(st.integers(1, 60), max_size=6))
def test_repair(text, cuts):
    enc = encode.encoder(encode.VOCABULARY)
    at = [0, *sorted({c for c in cuts if c < len(text)}), len(text)]
    run = [enc.encode_ordinary(text[a:b]) for a, b in zip(at, at[1:])]
    assert encode.repaired(enc, run) == enc.encode_ordinary(text)


def test_whole_documents(spark, reference, monkeypatch):
    rnd = random.Random(3)
    words = [*"the of vendor lab-sample 2,750 naïve l'été 会議 請求書 <p> &amp; 🙂".split(), "\n", "\r\n\r\n", "   ", "don't"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([3, 60, 400]))) for _ in range(60)]
    texts += ["漢字かな" * 3000, "x" * 50_000, " " * 20_000, "a\n\n" * 4000, "<|endoftext|> here", "é" * 900]
    rows = [(i, t, 1) for i, t in enumerate([*texts, *texts[:5], None, "", " "])] + [(None, "no id", 1), (0, texts[0], 1), (1, "other text", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = Counter((r.doc_id, tuple(r.ids)) for r in encode.encode(df).collect())
    assert got == Counter({(d, tuple(reference(t or ""))) for d, t, _ in rows})


def test_hot_chunk(spark, reference):
    text = "This call may be recorded for training. " * 40
    df = spark.range(3000).selectExpr("id as doc_id", f"'{text}' as text").coalesce(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array([text] * 9000)], names=["doc_id", "text"])
    groups = Counter((h, s) for b in encode.chunked(iter([batch])) for h, s in zip(b.column("hash").to_pylist(), b.column("salt").to_pylist()))
    assert max(groups.values()) <= encode.OWN
    got = encode.encode(df).collect()
    assert len(got) == 3000 and {tuple(r.ids) for r in got} == {tuple(reference(text))}


def test_wide_ids(spark, tmp_path):
    """A vocabulary beyond 16 bits keeps its ids."""
    lines = open(encode.VOCABULARY, "rb").read().split(b"\n")
    moved = [b" ".join((a, str(int(b) + 60_000).encode())) if int(b) >= 256 else line for line in lines if line for a, b in [line.split()]]
    (tmp_path / "wide.tiktoken").write_bytes(b"\n".join(moved))
    text = "The vendor moved the naïve draft — 2,750 of 会議 — after lunch. " * 40
    df = spark.createDataFrame([(1, text), (2, text[5:])], "doc_id bigint, text string")
    plain, wide = ({r.doc_id: r.ids for r in encode.encode(df, vocabulary=v).collect()} for v in (encode.VOCABULARY, str(tmp_path / "wide.tiktoken")))
    assert wide == {d: [i + 60_000 if i >= 256 else i for i in ids] for d, ids in plain.items()} and max(map(max, wide.values())) > 1 << 16


def test_empty(spark):
    assert encode.encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
