"""Abusive, hateful and sexual content by class-conditional Kneser-Ney models.

Two trigram models are fitted on reviewed documents, one of offending and one of ordinary text. Their
lowest levels back off to the same shared counts, so a rare expression speaks for neither, and they
are compared at the longest context that the offending class has seen, so an ordinary expression that
the reviewed documents happen to lack doesn't count as offending. A document's score is the highest
mean log-likelihood ratio over ``WINDOW`` consecutive words: a long document is judged by its worst
passage and not by its average. Reviews label whole documents; which passages of an offending one
offend is found by refitting: at first all of it stands for the class, then only passages that the
models tell apart.

From which score a document is found is chosen from the reviews, too: the reviewed documents are
split into ``FOLDS`` parts, copies into the same, each part is scored by models fitted on the others,
and the score that agrees best with the reviewers (by F1) is taken.

The fit's sample is bounded: at most ``FIT_DOCS`` reviewed documents of at most ``FIT_CHARS``
characters each and ``FIT_TOTAL`` in all, chosen by a hash of their ids; so the broadcast models are
bounded, too. Scoring reads every document whole, in Arrow batches with numpy, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.sources import cut

FIT_DOCS, FIT_CHARS, FIT_TOTAL, FOLDS = 20_000, 200_000, 25_000_000, 4
ROUNDS, WINDOW, SHORTEST, DISCOUNT = 4, 5, 3, 0.75
#: Mean log-likelihood ratio (nats a word) from which a passage offends in refitting.
PASSAGE = 1.0
#: Occurrences in reviewed documents that don't yet count for a passage in refitting; tokens a task remembers.
SUPPORT = 2
REMEMBERED = 1_000_000
#: Characters that stand for letters in disguised spelling, and those that hide one.
STAND_INS = str.maketrans("013457@$!|", "oieastasii")

_TAG = re.compile(r"<[^<>]*>|&[a-z]+;")
_RUN = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[a-z] ){2,}[a-z](?![^\W\d_])")
_HIDDEN = re.compile(r"(?<=\w)[*#_]+(?=\w)")
#: Signs of languages that are written without blanks; each counts as a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def plain_word(raw: str) -> str:
    """The word behind a lower-case token: no markup, punctuation, stand-ins, separators or lengthening; '' if there is none.

    Each hidden letter stays as ``?``.
    """
    w = _TAG.sub("", raw) if "<" in raw or "&" in raw else raw
    begin, end = 0, len(w)
    while begin < end and not (w[begin].isalnum() or w[begin] in "_@$"):
        begin += 1
    while end > begin and not (w[end - 1].isalnum() or w[end - 1] == "_" or w[end - 1] in "$@" and w[begin:end].strip("$@")):
        end -= 1
    w = w[begin:end]
    if w.isalpha():
        return _RUN.sub(r"\1", w)
    if not any(c.isalpha() for c in w) and not any(c in "@$!" for c in w) and not re.fullmatch(r"\d[a-z\d]*", w):
        return ""
    w = w.replace("’", "'")
    if re.fullmatch(r"[^\W\d_](?:[.\-_*][^\W\d_])+", w):  # one letter at a time
        w = re.sub(r"[.\-_*]", "", w)
    w = _HIDDEN.sub(lambda m: "?" * len(m.group()), w)
    if any(c.isalpha() for c in w) and any(c in "013457@$!|" for c in w):
        w = w.translate(STAND_INS)
    w = re.sub(r"[^\w?']+", "", w)
    return _RUN.sub(r"\1", w) if any(c.isalpha() for c in w) else ""


def tokens(text: str) -> list[str]:
    """Raw lower-case tokens, with line ends as tokens of their own; letters set apart are joined, signs of languages without blanks set apart."""
    low = text.lower()
    if not low.isascii():
        low = _UNSPACED.sub(r" \g<0> ", low.replace("。", ". ").replace("！", "! ").replace("？", "? "))
    if _SPACED.search(low):
        low = _SPACED.sub(lambda m: m.group().replace(" ", ""), low)
    return low.replace("\n", " \n ").replace("\r", " \n ").replace("</p>", " \n ").split(" ")


class Lookup:
    """Places of 64-bit keys in a sorted table; one gather a key, and a search for the few that share a slot."""

    BITS = 21

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        h = self._slot(keys)
        self.place = np.full(1 << self.BITS, -1, np.int32)
        self.place[h] = np.arange(len(keys), dtype=np.int32)
        self.shared = np.bincount(h, minlength=1 << self.BITS) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it has none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        h = self._slot(keys)
        at = self.place[h]
        miss = self.keys[at] != keys
        again = np.flatnonzero(miss & self.shared[h])
        at = np.where(miss, np.int32(-1), at)
        if len(again):
            k = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            at[again] = np.where(self.keys[k] == keys[again], k, -1)
        return at


class Words(dict):
    """Raw tokens to twice the word's id, plus one where a sentence ends. Word 0 is a passage's edge, 1 any other word; -2 and -1 are no words."""

    def __init__(self, vocabulary: dict[str, int], masked: dict[tuple[str, str, int], list[str]]):
        self.vocabulary, self.masked = vocabulary, masked

    def __reduce__(self):
        return Words, (self.vocabulary, self.masked)

    def __missing__(self, raw: str) -> int:
        w = plain_word(raw)
        i = self.vocabulary.get(w, 1) if w else -1
        if i == 1 and "?" in w:
            i = self.vocabulary.get(self.unmasked(w), 1)
        if i == 1 and _RUN.search(raw):  # a lengthened letter that is double in the word
            i = self.vocabulary.get(plain_word(_RUN.sub(r"\1\1", raw)), 1)
        code = 2 * i + (raw[-1:] in {".", "!", "?", "\n"})
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = code
        return code

    def unmasked(self, w: str) -> str:
        """The most frequent word that ``w`` may be, with a letter for each ``?``, else with one for each run of them; '' if none."""
        for shape in (w, re.sub(r"\?+", "?", w)):
            fits = re.compile(re.escape(shape).replace("\\?", "."))
            for word in self.masked.get((shape[0], shape[-1], len(shape)), ()):
                if fits.fullmatch(word):
                    return word
        return ""

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word ids of all texts with edges between passages, and where each text begins."""
        codes: list[int] = [1]
        begins = []
        for text in texts:
            begins.append(len(codes))
            if text:
                codes += [self[raw] for raw in tokens(text)]
            codes.append(1)
        code = np.asarray(codes, np.int32)
        word, ends = code >> 1, code & 1
        word[word < 0] = np.where(ends[word < 0] > 0, 0, -1)
        kept = np.where(word >= 0, 1 + (ends & (word > 0)), 0)  # a word that ends a sentence is followed by an edge
        at = np.concatenate([[0], np.cumsum(kept)])
        out = np.repeat(word, kept)
        out[at[1:][kept == 2] - 1] = 0
        return out.astype(np.int64), at[np.asarray(begins, np.int64)]


class Models:
    """Both classes as tables of log-likelihood ratios over the word sequences of the fit's sample; documents are found from the score ``found_at`` on."""

    found_at = np.inf

    def __init__(self, texts: list[str], offends: list[bool]):
        seen: dict[str, int] = {}
        for text in texts:
            for raw in tokens(text):
                seen[raw] = seen.get(raw, 0) + 1
        plain: dict[str, int] = {}
        for raw, n in seen.items():
            if (w := plain_word(raw)) and "?" not in w:
                plain[w] = plain.get(w, 0) + n
        vocabulary = {w: i for i, w in enumerate(sorted(plain), 2)}
        masked: dict[tuple[str, str, int], list[str]] = {}
        for w in sorted(plain, key=lambda w: (-plain[w], w)):
            masked.setdefault((w[0], w[-1], len(w)), []).append(w)
        self.words, self.size = Words(vocabulary, masked), len(vocabulary) + 2
        ids, begins = self.words.ids(texts)
        w, v = ids[1:], ids[:-1]
        self.pairs = Lookup(np.unique((v * self.size + w)[w > 0]))
        _, triple = self._keys(ids)
        self.triples = Lookup(np.unique(triple[triple >= 0]))
        bad = np.repeat(np.asarray([False, *offends]), np.diff([0, *begins, len(ids)]))
        passage = np.cumsum(ids == 0)
        offending, ordinary = bad, ~bad
        for k in range(ROUNDS):
            counts = self._counts(np.where(offending, ids, 0))
            last = k + 1 == ROUNDS
            # A passage is judged without itself and one copy: reviewers err, and what few documents hold proves nothing.
            self._estimate(self._levels(counts if last else tuple(np.maximum(n - SUPPORT, 0) for n in counts)), self._levels(self._counts(np.where(ordinary, ids, 0))))
            if not last:
                high = np.full(passage[-1] + 1, -np.inf)
                np.maximum.at(high, passage, self._windows(ids))
                offending, ordinary = bad & (high > PASSAGE)[passage], ~bad & (high <= 2 * PASSAGE)[passage]

    def _keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the place of its pair, and the key of its triple; -1 without one."""
        w, v = ids[1:], ids[:-1]
        pair = np.where(w > 0, self.pairs.find(v * self.size + w), -1)
        context = np.concatenate([[-1], pair[:-1]])
        return pair, np.where((context >= 0) & (w > 0), context * np.int64(self.size) + w, -1)

    def _counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the pairs and triples of the tables stand in ``ids``."""
        pair, key = self._keys(ids)
        triple = np.where(key >= 0, self.triples.find(key), -1)
        return np.bincount(pair[pair >= 0], minlength=len(self.pairs.keys)).astype(float), np.bincount(triple[triple >= 0], minlength=len(self.triples.keys)).astype(float)

    def _levels(self, counts: tuple[np.ndarray, np.ndarray]):
        """Kneser-Ney probabilities of one class: words, shares left by each word's and each pair's discounts, pairs, triples."""
        n2, n3 = counts
        v, w = self.pairs.keys // self.size, self.pairs.keys % self.size
        context, w3 = self.triples.keys // self.size, self.triples.keys % self.size
        of = lambda place, weights, n: np.bincount(place, weights=weights, minlength=n)
        shared = (of(w, None, self.size) + 0.5) / (len(w) + 0.5 * self.size)
        kinds = of(w, n2 > 0, self.size)  # in how many contexts a word stands
        total = kinds.sum()
        p1 = np.maximum(kinds - DISCOUNT, 0) / max(total, 1.0) + (DISCOUNT * (kinds > 0).sum() / total if total else 1.0) * shared
        lower = np.searchsorted(self.pairs.keys, w[context] * self.size + w3)  # a triple's own last pair
        # A pair counts by the words before it; nothing stands before a passage's first word, so there by its uses.
        k2 = np.where(v == 0, n2, of(lower, n3 > 0, len(n2)))
        after1, after2 = of(v, k2, self.size), of(context, n3, len(n2))
        left1 = np.where(after1 > 0, DISCOUNT * of(v, k2 > 0, self.size) / np.maximum(after1, 1), 1.0)
        left2 = np.where(after2 > 0, DISCOUNT * of(context, n3 > 0, len(n2)) / np.maximum(after2, 1), 1.0)
        p2 = np.maximum(k2 - DISCOUNT, 0) / np.maximum(after1[v], 1) + left1[v] * p1[w]
        p3 = np.maximum(n3 - DISCOUNT, 0) / np.maximum(after2[context], 1) + left2[context] * p2[lower]
        return (p1, left1, left2, p2, p3), (after1 > 0, after2 > 0)

    def _estimate(self, offending, ordinary) -> None:
        (t, (self.knows1, self.knows2)), (o, _) = offending, ordinary
        self.one, self.left1, self.left2, self.two, self.three = (np.log(x) - np.log(y) for x, y in zip(t, o))

    def _ratios(self, ids: np.ndarray) -> np.ndarray:
        """The log-likelihood ratio of each word in its place, at the longest context that the offending class knows; 0 at edges."""
        w, v = ids[1:], ids[:-1]
        pair, key = self._keys(ids)
        context = np.concatenate([[-1], pair[:-1]])
        out = self.one[w] + np.where(self.knows1[v], self.left1[v], 0.0)
        has = (pair >= 0) & self.knows1[v]
        out[has] = self.two[pair[has]]
        known = np.flatnonzero((context >= 0) & (w > 0))
        known = known[self.knows2[context[known]]]
        triple = self.triples.find(key[known])
        out[known] = np.where(triple >= 0, self.three[triple], self.left2[context[known]] + out[known]) if len(self.three) else out[known]
        return np.concatenate([[0.0], np.where(w == 0, 0.0, out)])

    def _windows(self, ids: np.ndarray) -> np.ndarray:
        """The mean ratio of the WINDOW words up to each place; of shorter passages that of all words, SHORTEST at least, and of a lone word as if WINDOW."""
        total = np.concatenate([[0.0], np.cumsum(self._ratios(ids))])
        at = np.arange(len(ids))
        edge = np.maximum.accumulate(np.where(ids == 0, at, 0))
        begin = np.maximum(np.maximum(at + 1 - WINDOW, 0), edge)
        last = np.minimum.accumulate(np.where(ids == 0, at, len(ids))[::-1])[::-1]  # the passage's end
        size = last - edge - 1
        return (total[at + 1] - total[begin]) / np.where(size > 1, np.clip(size, SHORTEST, WINDOW), WINDOW)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        ids, begins = self.words.ids(texts)
        return np.maximum.reduceat(self._windows(ids), begins) if len(begins) else np.zeros(0)


def threshold(scores: np.ndarray, offends: np.ndarray) -> float:
    """The score from which on documents are best taken for offending, by F1; of all about as good the middle one.

    About as good is what differs by less than one document among the offending ones.
    """
    order = np.argsort(-scores, kind="stable")
    right, n = np.cumsum(offends[order]), np.arange(1, len(order) + 1)
    f1 = np.where(np.append(np.diff(scores[order]), -1.0) < 0, 2 * right / (n + offends.sum()), -1.0)  # no cut between equal scores
    good = np.flatnonzero(f1 >= f1.max() - 0.4 / offends.sum())
    after = scores[order][min(good[-1] + 1, len(order) - 1)]
    return float((scores[order][good[0]] + after) / 2)


def _held_out(sample):
    """Scores of each part of the sample by models fitted on the others; a task does one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, offends = sample.value
        part = np.asarray([xxhash.xxh3_64_intdigest(t) % FOLDS for t in texts])
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rest, mine = np.flatnonzero(part != k), np.flatnonzero(part == k)
                if len({offends[i] for i in rest}) == 2 and len(mine):
                    scores = Models([texts[i] for i in rest], [offends[i] for i in rest]).scores([texts[i] for i in mine])
                    yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(scores, pa.float64())], names=["place", "score"])

    return run


def fitted(docs: DataFrame, reviews: DataFrame, doc: str = "doc_id", text: str = "text", verdict: str = "verdict") -> Models | None:
    """Models fitted on reviewed documents; a document's class is the majority of its verdicts, ties and null verdicts are left out.

    None if either class has no document with text. With too few reviewed documents to hold any
    offending one out, the threshold is chosen on the documents of the fit.
    """
    spark = docs.sparkSession
    votes = reviews.where(F.col(verdict).isin(0, 1)).groupBy(F.col(doc).alias("id")).agg(F.sum(F.col(verdict) * 2 - 1).alias("votes"))
    chosen = votes.where("votes <> 0 and id is not null").orderBy(F.xxhash64("id"), "id").limit(FIT_DOCS)  # so small that it can be broadcast
    corpus = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).where(F.length("text").between(1, FIT_CHARS))
    reviewed = cut(corpus.join(F.broadcast(chosen), "id"))
    sizes = reviewed.groupBy("id").agg(F.sum(F.length("text")).alias("chars"))  # FIT_DOCS rows at most
    so_far = F.sum("chars").over(Window.orderBy(F.xxhash64("id"), "id"))
    inside = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= FIT_TOTAL).select("id")
    rows = sorted((r.offends, r.text) for r in reviewed.join(F.broadcast(inside), "id").select("text", (F.col("votes") > 0).alias("offends")).collect())  # the fit doesn't depend on the order of tasks
    if not rows or rows[0][0] == rows[-1][0]:
        return None
    texts, offends = [t for _, t in rows], [bad for bad, _ in rows]
    sample = spark.sparkContext.broadcast((texts, offends))
    held = spark.range(0, FOLDS, 1, FOLDS).mapInArrow(_held_out(sample), "place bigint, score double").collect()
    models = Models(texts, offends)
    place, score = np.asarray([r.place for r in held], np.int64), np.asarray([r.score for r in held])
    bad = np.asarray(offends)
    models.found_at = threshold(score, bad[place]) if bad[place].any() else threshold(models.scores(texts), bad)
    return models


def scored(docs: DataFrame, models: Models | None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, found): the highest mean log-likelihood ratio of any WINDOW words of each document,
    and whether it is above the models' threshold.

    Null, empty and wordless texts score 0, as do all without models, and are not found; repeated
    rows are scored each; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            score = m.scores(batch.column(1).to_pylist()) if m else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(score > (m.found_at if m else 0))], names=["doc_id", "score", "found"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, score double, found boolean")


def found(scores: DataFrame) -> DataFrame:
    """(doc_id): the documents that are found, each once."""
    return scores.where("found").select("doc_id").distinct()


def rates(docs: DataFrame, models: Models | None, text: str = "text", source: str = "source") -> DataFrame:
    """(source, n_docs, n_found, rate): by source as written in any case, with any blanks, hyphens as underscores; a missing source is null."""
    name = F.translate(F.lower(F.trim(F.col(source))), "- ", "__")
    kinds = docs.select(F.when(name != "", name).alias("source"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(texts) > m.found_at if m else np.zeros(len(texts), bool))], names=["source", "found"])

    flags = kinds.mapInArrow(run, "source string, found boolean")
    return flags.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("found").alias("n_found"), F.avg(F.col("found").cast("double")).alias("rate"))
