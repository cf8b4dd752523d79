"""Test passages inside training documents, whole or in part, and the spans to remove.

The n-grams of the normalised test items form a hash table that is broadcast; every document is
scanned once by the windows of its normalised words, in Arrow batches. A stretch of at least
``STRETCH`` words with at most one in ten changed or missing holds ``SEEDS`` intact n-grams or more,
so a document with fewer for an item cannot hold one of its stretches; the rest are verified by
aligning words from each run of intact n-grams to both sides, over all alignments that the errors
allow. A run of wording that many items share is tried only where the words around it, in any order,
are enough for a stretch. Nothing is shuffled: the corpus is read, scanned and left where it is.

The table's size is checked: items of more than ``BLOCK_WORDS`` words in all are taken in blocks of
about that size, each with its own broadcast and scan, so no item and no document is left out; the
driver holds one block at a time, and a broadcast lies on disk.

A document's time and memory grow with its words and its hits: they are sorted once, its words are
placed once, and the hits of one document are taken in parts of about ``HITS``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, STRETCH, ONE_IN = 6, 20, 10
#: Intact n-grams of a stretch at least: each changed word breaks as many as an n-gram has words.
SEEDS = STRETCH - GRAM + 1 - GRAM * (STRETCH // ONE_IN)
BLOCK_WORDS = 4_000_000
#: Places of n-grams in items that are looked up at once, and runs that are compared with what stands around them at once.
HITS, RUNS = 1_000_000, 4_096
#: A stretch holds one of less than twice its least length; so far around a run its words lie in the item, and by the errors farther in the document.
NEAR = 2 * STRETCH - 1 - GRAM
FAR = NEAR + (2 * STRETCH - 1) // ONE_IN
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
#: Markup, entities, time stamps and the number or sign that a line begins with have no group, so they come out empty; case,
#: punctuation and layout fall away. A sign of a language without blanks is a word.
_WORD = re.compile(
    rf"</?[a-z!][^<>]*>|&#?\w{{1,8}};|{_CLOCK}(?!\w)|^[ \t]*+[>#*\[(-]*+[ \t]*+\d{{1,5}}[\]).:]*(?=\s)|([\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]|[^\W_\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]+(?:['’][^\W_]+)*)", re.M
)


def words(text: str) -> list[str]:
    """Normalised words; markup, time stamps and numbers of lines are none."""
    return [w for w in _WORD.findall(text.lower()) if w]


def _spans(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each of :func:`words`, in characters of the text as it stands."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return [m.span() for m in _WORD.finditer(low) if m.group(1)]


def _hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of each window of GRAM word ids."""
    n = len(ids) - GRAM + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM):
        h = h * _PRIME + ids[k : k + n]
        h ^= h >> np.uint64(29)
    return h


class Items:
    """The broadcast table: word ids, the n-grams' hashes once each, their rows by items with their places there, and the items' word ids.

    Passages that are the same word by word stand here once, with all their ids.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        same: dict[bytes, list[int]] = {}
        self.items: list[np.ndarray] = []
        for item, text in rows:
            ids = np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64)
            owners = same.setdefault(ids.tobytes(), [])
            if not owners:
                self.items.append(ids)
            owners.append(item)
        self.ids = [sorted(set(x)) for x in same.values()]
        hashes = [_hashes(x.astype(np.uint64)) for x in self.items]
        owners = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        places = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in hashes]])
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.lexsort((owners, every))
        self.owners, self.places = owners[order], places[order]
        self.hashes, row, self.uses = np.unique(every[order], return_inverse=True, return_counts=True)
        self.rows = row * len(self.items) + self.owners  # in order, so an n-gram's rows in a range of items are found by search
        self.begins = np.cumsum([0, *map(len, self.items)])
        self.words = np.concatenate([np.zeros(0, np.int64), *self.items])

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ids, n-gram's place here, its uses) of every n-gram of ``ids`` that an item has."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        whole = np.flatnonzero(unknown[GRAM:] == unknown[:-GRAM]) if len(ids) >= GRAM else np.zeros(0, np.int64)
        if not len(whole) or not len(self.hashes):
            return (np.zeros(0, np.int64),) * 3
        h = _hashes(ids.astype(np.uint64))[whole]
        gram = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[gram] == h
        return whole[hit], gram[hit], self.uses[gram[hit]]

    def seeds(self, at: np.ndarray, gram: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, place in the item, item's place here) of each n-gram in each item from ``low`` to before ``high``."""
        first, last = (np.searchsorted(self.rows, gram * len(self.items) + x) for x in (low, high))
        n = last - first
        row = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(at, n), self.places[row], self.owners[row]


def _reach(item: np.ndarray, doc: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """By errors, ``most`` at most: (words of ``item``, words of ``doc``) up to the farthest match with so many before it.

    Both are read from their beginning; an error is a word changed, missing or put in between. All
    alignments count: their edit distances fill the band of ``most`` diagonals to either side.
    """
    far = {0: (0, 0)}
    across = np.arange(2 * most + 1)
    errors = np.where(across >= most, across - most, len(item) + len(across))
    padded = np.full(len(item) + 2 * most, -1, np.int64)
    part = doc[: len(item) + most]
    padded[most : most + len(part)] = part
    for i, w in enumerate(item.tolist(), 1):
        same = padded[i - 1 : i + 2 * most] == w
        ends = np.where(same, errors, most + 1)
        at = int(ends.argmin())
        if ends[at] <= most:
            far[int(ends[at])] = i, i + at - most
        step = errors + ~same
        step[:-1] = np.minimum(step[:-1], errors[1:] + 1)
        errors = np.minimum.accumulate(step - across) + across
        if errors.min() > most:
            break
    return far


def _around(item: np.ndarray, doc: np.ndarray, a: int, b: int, n: int) -> tuple[set[tuple[int, int, int]], bool]:
    """The longest stretch around the ``n`` words from ``a`` of the item that stand from ``b`` in ``doc`` and those
    that reach farthest to either side, and whether any nearly is one."""
    most = len(item) // ONE_IN
    left = [(e, *x) for e, x in _reach(item[:a][::-1], doc[max(0, b - a - most) : b][::-1], most).items()]
    right = [(e, *x) for e, x in _reach(item[a + n :], doc[b + n : b + n + len(item) + most], most).items()]
    (e1, i1, j1), (e2, i2, j2) = np.array(left).T, np.array(right).T
    size, errors = i1[:, None] + n + i2, e1[:, None] + e2
    fits = np.where((size >= STRETCH) & (errors * ONE_IN <= size), size, 0)
    near = bool(((size >= STRETCH - STRETCH // ONE_IN) & (errors <= STRETCH // ONE_IN)).any())
    if not fits.any():
        return set(), near
    best = [np.unravel_index(np.where(fits, x, -1).argmax(), fits.shape) for x in (size, i1[:, None] * (len(item) + 1) + i2, i2 * (len(item) + 1) + i1[:, None])]
    return {(int(size[k, m]), b - int(j1[k]), b + n + int(j2[m])) for k, m in best}, near


def stretches(item: np.ndarray, doc: np.ndarray, a: int, b: int, n: int) -> set[tuple[int, int, int]]:
    """(words, begin, end) of stretches of the item that go through its ``n`` words from ``a``, which stand from
    ``b`` in ``doc``: the longest and those that reach farthest to either side; begin and end by words of ``doc``.

    Both are word ids. Each stretch holds intact words for an n-gram in one place, so one that is tried
    at every run of n-grams is found. It may leave a run early where a word comes twice; that only
    decides if it is short of a stretch otherwise, so then each n-gram of the run is tried.
    """
    if not np.array_equal(item[a : a + n], doc[b : b + n]):
        return set()
    found, near = _around(item, doc, a, b, n)
    if found or not near:
        return found
    return set().union(*(_around(item, doc, a + k, b + k, GRAM)[0] for k in range(n - GRAM + 1)))


def _runs(at: np.ndarray, places: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, place in the item, place in ``at``, words, n-grams of its item) of each run of n-grams, by items and diagonals."""
    order = np.lexsort((at, at - places, items))
    at, places, items = at[order], places[order], items[order]
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(places) != 1) | (np.diff(items) != 0)]))
    grams = np.diff(np.append(opens, len(at)))
    _, which = np.unique(items[opens], return_inverse=True)
    return items[opens], places[opens], at[opens], grams + GRAM - 1, np.bincount(which, weights=grams)[which]


def _hopeful(t: Items, doc: np.ndarray, items: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run whether as many words stand around it in both as a stretch must have, in whatever order."""
    out = n >= STRETCH - STRETCH // ONE_IN
    rest = np.flatnonzero(~out)
    padded = np.concatenate([np.zeros(FAR, np.int64), doc, np.zeros(FAR, np.int64)])
    near, far = np.arange(NEAR), np.arange(FAR)
    for part in np.split(rest, range(RUNS, len(rest), RUNS)):
        first, last = t.begins[items[part]], t.begins[items[part] + 1]
        left, right = (first + a[part])[:, None] - 1 - near, (first + a[part] + n[part])[:, None] + near
        mine = [np.where(x >= first[:, None], t.words[np.maximum(x, 0)], -1) if k else np.where(x < last[:, None], t.words[np.minimum(x, len(t.words) - 1)], -1) for x, k in ((left, 1), (right, 0))]
        theirs = [padded[np.clip(x + FAR, 0, len(padded) - 1)] for x in (b[part][:, None] - 1 - far, (b[part] + n[part])[:, None] + far)]
        shared = sum((m[:, :, None] == d[:, None, :]).any(2).sum(1) for m, d in zip(mine, theirs))
        out[part] = shared + n[part] >= STRETCH - STRETCH // ONE_IN
    return out


def _document(t: Items, doc: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """(item's place in the table, words, begin, end by words of ``doc``) of each stretch in a document."""
    at, gram, uses = windows
    steps = -(-int(uses.sum()) // HITS)  # wording that many items share is taken for some items after others
    edges = np.linspace(0, len(t.items), steps + 1).astype(int).tolist()
    for low, high in zip(edges, edges[1:]):
        hits = t.seeds(at, gram, low, high)
        if not len(hits[0]):
            continue
        items, a, b, size, grams = _runs(*hits)
        keep = np.flatnonzero(grams >= SEEDS)
        keep = keep[np.isin(items[keep], items[keep[_hopeful(t, doc, items[keep], a[keep], b[keep], size[keep])]])]
        bounds = np.append(np.flatnonzero(np.diff(items[keep], prepend=-1)), len(keep)).tolist()
        for lo, hi in zip(bounds, bounds[1:]):
            item = int(items[keep[lo]])
            found = set().union(*(stretches(t.items[item], doc, *x) for x in zip(*(v[keep[lo:hi]].tolist() for v in (a, b, size)))))
            covered: list[tuple[int, int]] = []
            for words_, begin, end in sorted(found, key=lambda x: (-x[0], x[1:])):
                new = begin
                for x, y in covered:  # in order and apart
                    if x > new:
                        break
                    new = max(new, y)
                if new < end:
                    yield item, words_, begin, end
                    joined = [(begin, end)]
                    for x, y in covered:
                        if y < joined[-1][0] or x > joined[-1][1]:
                            joined.append((x, y))
                        else:
                            joined[0] = min(x, joined[0][0]), max(y, joined[0][1])
                    covered = sorted(joined)


def _scanner(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Items = table.value
        get = t.vocabulary.get
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flat: list[int] = []
            begins = []
            for text in texts:
                begins.append(len(flat))
                if text:
                    flat += [get(w, 0) for w in words(text)]
                flat.append(0)
            ids = np.asarray(flat, np.int64)
            at, gram, uses = t.windows(ids)
            owner = np.searchsorted(begins, at, "right") - 1
            bounds = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(at)).tolist()
            for lo, hi in zip(bounds, bounds[1:]):
                d = int(owner[lo])
                begin, end = begins[d], begins[d + 1] - 1 if d + 1 < len(begins) else len(ids) - 1
                span = None
                for item, size, b, e in _document(t, ids[begin:end], (at[lo:hi] - begin, gram[lo:hi], uses[lo:hi])) if uses[lo:hi].sum() >= SEEDS else ():
                    span = span or _spans(texts[d])
                    for name in t.ids[item]:
                        for column, v in zip(out, (name, docs[d], span[b][0] + 1, span[e - 1][1], size)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["item_id", "doc_id", "start_pos", "end_pos", "n_words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text") -> DataFrame:
    """(item_id, doc_id, start_pos, end_pos, n_words): each stretch of an item's passage in a document.

    A stretch has at least 20 consecutive words of the passage with at most one word in ten changed,
    missing or put in between. Longer ones come first, and one gives a row if it has words that none
    before it has; so rows of a passage may overlap where errors are too many for one stretch and few
    enough for each of two. Positions count from 1 in code points, the end is included. Null and
    empty texts, and passages shorter than a stretch, match nothing; repeated rows repeat their
    stretches; an empty table gives no rows. Items with a null id are left out.
    """
    rows = items.select(F.col(item).cast("long").alias("item_id"), F.col(passage).alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    corpus = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    found = None
    for k in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        table = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in block.collect()]))
        part = corpus.mapInArrow(_scanner(table), "item_id bigint, doc_id bigint, start_pos bigint, end_pos bigint, n_words bigint")
        found = part if found is None else found.unionByName(part)
    return found


def cleaned(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_removed): the documents with leaked stretches, without them; overlapping ones go as one."""
    spans = leaks(docs, items, doc, text).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("spans"))
    joined = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(spans, "doc_id")
    step = "(a, x) -> struct(a.text || substring(text, a.at, greatest(int(x.start_pos) - a.at, 0)) as text, greatest(a.at, int(x.end_pos) + 1) as at)"
    rest = "a -> a.text || substring(text, a.at)"
    return joined.select("doc_id", F.expr(f"aggregate(spans, struct('' as text, 1 as at), {step}, {rest})").alias("text"), F.size("spans").cast("long").alias("n_removed"))
