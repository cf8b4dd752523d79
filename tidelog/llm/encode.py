"""Encoding of a corpus with a public byte-level BPE, with chunks that documents share encoded once.

1. A rolling hash over the bytes cuts every text into content-defined chunks; the same passage gives
   the same chunks wherever it stands.
2. Rows are shuffled by the chunk's 128-bit hash and each distinct chunk is encoded once; a task sends
   a chunk's text only at its first occurrence. Of a chunk that a task sees often (a boilerplate, a
   text copied a million times) only the first ``SHARED`` rows go to the group that all tasks share;
   the rest go to groups of the task's own, of ``OWN`` rows at most and encoded once each. So no group
   grows with the number of copies, only, by a few rows, with the number of tasks.
3. Tokens are shuffled back by document and the joins repaired: a join between words is exact as it
   stands; at any other, the last word of the left chunk is re-encoded with what follows until a word
   boundary of the right chunk is met again, from where both agree to the end.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a chunk: least, usual (a power of two), most; bytes from a cut's place to look for a word's start.
LEAST, USUAL, MOST, REACH = 128, 512, 8192, 64
WINDOW = 16
#: Rows of a chunk that a task gives to the group shared by all, rows of its own groups, chunks it remembers.
SHARED, OWN, REMEMBERED = 8, 4096, 1_000_000
_GEAR = np.random.default_rng(20240917).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_WORD = regex.compile(PATTERN)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _width(enc: tiktoken.Encoding) -> str:
    """The type of a token's id between the shuffles: 16 bits if all ids fit."""
    return "<u2" if enc.max_token_value < 1 << 16 else "<u4"


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut in all texts of a batch, and whether a word starts there for certain."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):  # the hash of the last 2, 4, 8, 16 bytes
        older = np.zeros_like(h)
        older[k:] = h[:-k] << np.uint32(k)
        h = h + older
    marks = np.flatnonzero((h & np.uint32((USUAL - 1) << 16)) == 0) + 1
    graph = (buf > 0x20) & (buf < 0x7F)
    starts = np.flatnonzero((buf[1:-1] == 0x20) & graph[:-2] & graph[2:]) + 1 if len(buf) > 2 else np.zeros(0, np.int64)
    at = np.searchsorted(starts, marks)
    word = np.where(at < len(starts), starts[np.minimum(at, max(len(starts) - 1, 0))] if len(starts) else 0, np.iinfo(np.int64).max)
    sure = word - marks <= REACH
    raw = marks.copy()
    for _ in range(3):  # to the next character's start
        inside = (raw < len(buf)) & ((buf[np.minimum(raw, len(buf) - 1)] & 0xC0) == 0x80)
        raw = raw + inside
    cuts, first = np.unique(np.where(sure, word, raw), return_index=True)
    return cuts, sure[first]


def _chunks(begin: int, end: int, cuts: np.ndarray, sure: np.ndarray, buf: np.ndarray) -> list[tuple[int, int, bool]]:
    """(begin, end, whether the join before it is exact) of one text's chunks."""
    out, at, exact = [], begin, True
    lo, hi = np.searchsorted(cuts, (begin + LEAST, end))
    for c, s in [*zip(cuts[lo:hi].tolist(), sure[lo:hi].tolist()), (end, True)]:
        while c - at > MOST + LEAST:
            stop = at + MOST
            while (buf[stop] & 0xC0) == 0x80:
                stop += 1
            out.append((at, stop, exact))
            at, exact = stop, False
        if c - at >= LEAST or c == end:
            out.append((at, c, exact))
            at, exact = c, s
    return out


_CHUNK = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("pos", pa.int32()), ("exact", pa.bool_()), ("hash", pa.binary()), ("salt", pa.int32()), ("text", pa.string())])
CHUNK_DDL = "key binary, doc bigint, pos int, exact boolean, hash binary, salt int, text string"


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) rows to chunk rows; null and empty texts give one empty chunk."""
    seen: dict[bytes, int] = {}
    sent: set[tuple[bytes, int]] = set()
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        whole = texts.buffers()[2]
        data = memoryview(whole)[offsets[0] : offsets[-1]] if whole is not None and len(offsets) else memoryview(b"")
        offsets = offsets - offsets[0]
        buf = np.frombuffer(data, np.uint8)
        cuts, sure = _cuts(buf, offsets) if len(buf) else (np.zeros(0, np.int64), np.zeros(0, bool))
        rows: list[list] = [[] for _ in _CHUNK]
        for i, doc in enumerate(ids):
            begin, end = int(offsets[i]), int(offsets[i + 1])
            key = xxhash.xxh3_128_digest(data[begin:end])
            for pos, (a, b, exact) in enumerate(_chunks(begin, end, cuts, sure, buf)):
                part = data[a:b]
                h = xxhash.xxh3_128_digest(part)
                n = seen.get(h, 0)
                seen[h] = n + 1
                salt = 0 if n < SHARED else (task * 1_000_003 + n // OWN) & 0x3FFFFFFF | 0x40000000
                fresh = (h, salt) not in sent
                if fresh:
                    if len(sent) >= REMEMBERED:  # forgetting costs only texts sent again
                        sent.clear()
                    sent.add((h, salt))
                for column, v in zip(rows, (key, doc, pos, exact, h, salt, str(part, "utf-8") if fresh else None)):
                    column.append(v)
            if len(rows[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _CHUNK)], schema=_CHUNK)
                rows = [[] for _ in _CHUNK]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _CHUNK)], schema=_CHUNK)
        if len(seen) > REMEMBERED:
            seen = {h: n for h, n in seen.items() if n >= SHARED}


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last, tokens = encoder(path), None, b""
        for batch in batches:
            out = []
            for h, salt, text in zip(batch.column("hash").to_pylist(), batch.column("salt").to_pylist(), batch.column("text").to_pylist()):
                if (h, salt) != last:  # a group's rows with text come first
                    last, tokens = (h, salt), np.asarray(enc.encode_ordinary(text), _width(enc)).tobytes()
                out.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc"), batch.column("pos"), batch.column("exact"), pa.array(out, pa.binary())], names=["key", "doc", "pos", "exact", "tokens"])

    return run


def _pieces(enc: tiktoken.Encoding, text: str, starts: list[int]) -> list[int]:
    """Tokens of the words of ``text`` that begin at ``starts``; each word is encoded by itself."""
    return [t for a, b in zip(starts, [*starts[1:], len(text)]) for t in enc.encode_ordinary(text[a:b])]


def repaired(enc: tiktoken.Encoding, run: list[list[int]]) -> list[int]:
    """Tokens of chunks whose joins are not known to lie between words, as if encoded as one text."""
    texts = [enc.decode_bytes(t).decode("utf-8") for t in run]
    done: list[int] = []
    tokens, text = run[0], texts[0]
    for k in range(1, len(run)):
        right, after = run[k], texts[k]
        left = [m.start() for m in _WORD.finditer(text)]
        tail = text[left[-1] :]
        window = tail + after
        ours, theirs = iter(_WORD.finditer(window)), iter(_WORD.finditer(after))
        mine, others, a, b = [], [], next(ours), next(theirs)
        while a is not None and b is not None and a.start() != b.start() + len(tail):
            if a.start() < b.start() + len(tail):
                mine.append(a.start())
                a = next(ours, None)
            else:
                others.append(b.start())
                b = next(theirs, None)
        kept = len(tokens) - len(enc.encode_ordinary(tail))
        done += tokens[:kept]
        if a is None or b is None:  # no word boundary is shared: the rest of the run is encoded as one text
            return done + enc.encode_ordinary(tail + "".join(texts[k:]))
        done += _pieces(enc, window[: a.start()], mine)
        tokens, text = right[len(_pieces(enc, after[: b.start()], others)) :], after[b.start() :]
    return done + tokens


def stitched(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, current, parts, exact = encoder(path), None, [], []
        width = _width(enc)
        docs: list = []
        out: list[np.ndarray] = []

        def finish() -> np.ndarray:
            if all(exact[1:]):
                return np.frombuffer(b"".join(parts), width).astype(np.int32)
            ids: list[int] = []
            at = 0
            while at < len(parts):
                stop = at + 1
                while stop < len(parts) and not exact[stop]:
                    stop += 1
                run_ = [np.frombuffer(p, width).tolist() for p in parts[at:stop]]
                ids += repaired(enc, run_) if len(run_) > 1 else run_[0]
                at = stop
            return np.asarray(ids, np.int32)

        def batch_of() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], names=["doc", "ids"])

        size = 0
        for batch in batches:
            for key, doc, pos, ok, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, key) != current:
                    if current is not None:
                        docs.append(current[0])
                        out.append(finish())
                        size += len(out[-1])
                    current, parts, exact = (doc, key), [], []
                    if size > 1_000_000:
                        yield batch_of()
                        docs, out, size = [], [], 0
                if pos == len(parts):  # a repeated row's chunks come again and are the same
                    parts.append(tokens)
                    exact.append(ok)
        if current is not None:
            docs.append(current[0])
            out.append(finish())
        if docs:
            yield batch_of()

    return run


def encode(df: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, ids): the token ids of every document, without special tokens.

    Null and empty texts give the empty list; blank text is encoded. Rows that repeat an id with the
    same text give one row, with other texts one row each; a null id is kept. Texts of any length are
    encoded whole. ``vocabulary`` is a rank file at the same path on every executor, of any size. Columns other than the two are not read; an empty table gives no rows.
    """
    rows = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    chunks = rows.mapInArrow(chunked, CHUNK_DDL)
    by_hash = chunks.repartition("hash", "salt").sortWithinPartitions("hash", "salt", F.col("text").isNull())
    tokens = by_hash.mapInArrow(_encoded(vocabulary), "key binary, doc bigint, pos int, exact boolean, tokens binary")
    by_doc = tokens.repartition("doc", "key").sortWithinPartitions("doc", "key", "pos")
    return by_doc.mapInArrow(stitched(vocabulary), "doc bigint, ids array<int>").withColumnRenamed("doc", doc)
