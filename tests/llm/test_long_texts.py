"""Texts that would make a careless pattern slow; each operator must take them in time."""

import time

import pytest

from tidelog.llm import encode, leakage, names, pii, toxicity, turns

N = 30_000
TEXTS = ["u" * N, "um" * N, "u" + "m" * N + "x", "uh " * N + "x", " " * N + "um", "=" * N + "a", "a " * N, "[" * N, "(" * N + ")" * N, "<" * N, "1" * N, "1 " * N, "a.b@" * N, " at a dot" * 1_000, "A. " * N, "x" * N + " street", "-" * N, "é" * N, "a\n" * N, "*" * N, "wor-d " * N, "you " + "i d i o t " * 1_000]
FINDER = pii.Finder(["Robert"])


@pytest.mark.parametrize("text", TEXTS, ids=[repr(t[:12]) for t in TEXTS])
def test_in_time(text):
    t = time.process_time()
    turns.text_of(*turns.parse(text))
    items = FINDER.find(text)
    pii.redacted(text[:1000], [x for x in items if x[1] <= 1000])
    leakage.words(text)
    [toxicity.plain_word(w) for w in toxicity.tokens(text)]
    names.keys_of(form) if (form := names.form_of(text)) else None
    turns.speaker_key(text)
    enc = encode.encoder(encode.VOCABULARY)
    cut = len(text) // 2
    if len(text) <= 200_000:
        assert encode.repaired(enc, [enc.encode_ordinary(text[:cut]), enc.encode_ordinary(text[cut:])]) == enc.encode_ordinary(text)
    assert time.process_time() - t < 10
