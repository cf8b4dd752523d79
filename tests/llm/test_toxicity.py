"""Scores on held-out documents of a small corpus whose labels are known."""

import random

import numpy as np
import pytest

from tidelog.llm import toxicity

PLAIN = ["the vendor moved the {} after lunch", "we need four more {} for the demo", "nobody wants to label the {} on friday", "my stupid {} ate the recording again", "shoot the {} at noon then burn the disc"]
FOUL = ["listen {}, your work is rubbish and so are you", "keep talking and i will smash your {} face in", "shut your mouth, you {} fool", "crawl back under your rock, you {}"]
THINGS, SLURS = ["draft", "lens", "menu", "ferry", "quote"], ["numpty", "wretched", "pathetic", "rotten"]
DISGUISE = [str, str.upper, lambda w: w.replace("o", "0").replace("e", "3"), lambda w: ".".join(w), lambda w: w[0] + "*" + w[2:], lambda w: w[:2] + w[2] * 4 + w[3:]]


def document(rnd, foul):
    lines = [rnd.choice(PLAIN).format(rnd.choice(THINGS)) for _ in range(rnd.randint(2, 9))]
    if foul:
        lines.insert(rnd.randint(0, len(lines)), rnd.choice(FOUL).format(rnd.choice(DISGUISE)(rnd.choice(SLURS))))
    return rnd.choice(["\n", ". "]).join(lines)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    labels = {d: rnd.random() < 0.3 for d in range(600)}
    rows = [(d, document(rnd, bad), rnd.choice(["Chat-Log", " chat_log", None])) for d, bad in labels.items()]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", None), (902, "!!! 12:30", ""), (None, "shut your mouth, you rotten fool", None)], "doc_id bigint, text string, source string")
    votes = [(d, int(labels[d] != (rnd.random() < 0.05)), "x") for d in range(300)] + [(5, None, "x"), (None, 1, "x"), (77, 1, "x"), (77, 0, "x")]
    return docs, spark.createDataFrame(votes, "doc_id bigint, verdict int, text string"), labels


def test_held_out(corpus):
    docs, reviews, labels = corpus
    models = toxicity.fitted(docs, reviews)
    scores = toxicity.scored(docs, models)
    found = {r.doc_id for r in toxicity.found(scores).collect()}
    held = {d for d in labels if d >= 300}
    bad = {d for d in held if labels[d]}
    assert len(found & bad) >= 0.95 * len(bad)
    assert len(found & held - bad) <= 0.05 * len(held - bad)
    by_id = {r.doc_id: r.score for r in scores.collect()}
    assert by_id[900] == by_id[901] == by_id[902] == 0 and len(by_id) == docs.count()
    rates = {r.source: r for r in toxicity.rates(docs, models).collect()}
    assert set(rates) == {"chat_log", None} and sum(r.n_docs for r in rates.values()) == 604
    assert all(r.rate == pytest.approx(r.n_found / r.n_docs) for r in rates.values())
    source = {r.doc_id: "chat_log" if r.source and r.source.strip() else None for r in docs.collect()}
    flags = [(source[r.doc_id], r.found) for r in scores.collect()]
    assert {s: (r.n_docs, r.n_found) for s, r in rates.items()} == {s: (sum(x == s for x, _ in flags), sum(x == s and f for x, f in flags)) for s in rates}


def test_no_reviews(spark, corpus):
    docs, reviews, _ = corpus
    assert toxicity.fitted(docs, reviews.where("verdict = 0")) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), None).count() == 0


def test_plain_words():
    for raw, w in {"p.a.t.h.e.t.i.c": "pathetic", "r0773n": "rotten", "f*ol!!": "f?ol", "f**ls": "f??ls", "d*mb@s$,": "d?mbass", "uselesssss": "useles", "<p>nobody</p>": "nobody", "12:30": "", "h-a-l-f": "half", "don't": "don't", "?": "", "$tupid,": "stupid"}.items():
        assert toxicity.plain_word(raw) == w, raw
    assert "idiot" in toxicity.tokens("you i d i o t now")
    assert toxicity.tokens("バカ野郎") == ["", "バ", "", "カ", "", "野", "", "郎", ""]


def test_hidden_letters():
    words = toxicity.Words({"fool": 2, "fuel": 3, "full": 4}, {("f", "l", 4): ["fool", "fuel", "full"]})
    assert [words[w] >> 1 for w in ("f**l", "f*el", "fu*l", "f*l", "f***l", "x*l")] == [2, 3, 3, 1, 1, 1]


def test_threshold():
    t = toxicity.threshold(np.asarray([9.0] * 18 + [8.0, 7.0, 3.0, 1.0, 1.0]), np.asarray([True] * 20 + [False] * 3))
    assert t == 5.0


def test_counts_of_pairs():
    """At the pair level a word counts by the words before the pair, not by its uses."""
    m = toxicity.Models(["a san diego. b san diego. c san diego", "a red dot. a red dot. a red dot"], [True, False])
    ids, _ = m.words.ids(["a san diego. b san diego. c san diego. a red dot. a red dot. a red dot"])
    (_, _, _, p2, _), _ = m._levels(m._counts(ids))
    at = lambda v, w: p2[m.pairs.find(np.asarray([m.words.vocabulary[v] * m.size + m.words.vocabulary[w]]))[0]]
    assert at("san", "diego") > at("red", "dot")


def test_sum_of_characters(spark, corpus, monkeypatch):
    docs, reviews, _ = corpus
    monkeypatch.setattr(toxicity, "FIT_TOTAL", 4_000)
    seen = []
    real = toxicity.Models.__init__
    monkeypatch.setattr(toxicity.Models, "__init__", lambda self, texts, offends: (seen.append(sum(map(len, texts))), real(self, texts, offends))[1])
    toxicity.fitted(docs, reviews)
    assert 3_000 < seen[-1] <= 4_000
