"""Leaked passages against a slow search that aligns every document with every item."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

from tidelog.llm import leakage

ITEMS = "item_id bigint, text string, doc_id int"
DOCS = "doc_id bigint, text string, item_id int, start_pos string"


def passage(rnd, n=60):
    return [rnd.choice(["bell", "ferry", "lamp", "granary", "tide", "widow", "quay", "amber", "census", "of", "the", "and"]) + rnd.choice(["", "s", "er", "ly", "ing"]) for _ in range(n)]


def noisy(rnd, ws, one_in):
    """``ws`` with one word in ``one_in`` changed or missing."""
    out = list(ws)
    for i in range(one_in // 2, len(ws), one_in):
        out[i] = rnd.choice([None, "other"])
    return [w for w in out if w]


def build(rnd):
    items = [(i, " ".join(passage(rnd)) + ".") for i in range(8)]
    docs, want = [], set()
    filler = lambda n: "\n".join(" ".join(rnd.choices("we sent a draft to someone near gate four".split(), k=9)) for _ in range(n))
    for d in range(60):
        i, text = rnd.choice(items)
        ws = text.rstrip(".").split()
        kind = d % 6
        a = rnd.randint(0, 20)
        part = {0: ws, 1: ws[a : a + 24], 2: [w.upper() + "," for w in ws], 3: noisy(rnd, ws, 12), 4: ws[a : a + 12], 5: noisy(rnd, ws, 4)}[kind]
        lines = [part[k : k + 7] for k in range(0, len(part), 7)]
        body = {0: "\n".join(f"[00:0{k % 10}:11] " + " ".join(x) for k, x in enumerate(lines)), 1: "\n> ".join(" ".join(x) for x in lines)}.get(kind, "<p>" + "&nbsp;".join(part) + "</p>")
        docs.append((d, f"{filler(3)}\n{body}\n{filler(2)}", 7, "x"))
        if kind < 4:
            want.add((i, d))
    return items, docs, want


def test_found_and_decoys(spark):
    items, docs, want = build(random.Random(2))
    docs += [(100, None, 7, "x"), (101, "", 7, "x"), (102, "İstanbul " + docs[0][1] + " tail " + docs[0][1], 7, "x"), docs[1]]
    items_df = spark.createDataFrame([(*r, 1) for r in items] + [(90, None, 1), (91, "", 1), (92, "too short", 1), (None, items[0][1], 1)], ITEMS)
    docs_df = spark.createDataFrame(docs, DOCS)
    got = leakage.leaks(docs_df, items_df).collect()
    first = {(i, 102) for i, d in want if d == 0}
    assert {(r.item_id, r.doc_id) for r in got} == want | first
    assert sum(r.doc_id == 102 for r in got) == 2
    texts = {d: t for d, t, *_ in docs}
    for r in got:
        inside = leakage.words(texts[r.doc_id][r.start_pos - 1 : r.end_pos])
        item = leakage.words(dict(items)[r.item_id])
        assert SequenceMatcher(None, item, inside, autojunk=False).ratio() > 0.4 and r.n_words >= leakage.STRETCH
    left = {r.doc_id: r.text for r in leakage.cleaned(docs_df.where("doc_id <> 1"), items_df).collect()}
    assert all(len(t) < len(texts[d]) for d, t in left.items())
    assert leakage.leaks(spark.createDataFrame(list((d, t, 7, "x") for d, t in left.items()), DOCS), items_df).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    items, docs, want = build(random.Random(4))
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 100)
    got = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*r, 1) for r in items], ITEMS))
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want


def test_empty(spark):
    some = spark.createDataFrame([(1, "a b c", 1)], ITEMS)
    none = spark.createDataFrame([], DOCS)
    assert leakage.leaks(none, some).count() == 0
    assert leakage.leaks(spark.createDataFrame([(1, "a b", 1, "x")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_quotation_beside_a_changed_stretch(spark):
    ws = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(104)]
    changed = [*ws[:25]]
    changed[8] = changed[17] = "other"
    own = [f"own{chr(97 + k)}" for k in range(20)]
    docs = [(1, " ".join(changed + own + ws[:12]), 7, "x"), (2, " ".join(ws[:12] + own + changed), 7, "x"), (3, " ".join(ws[:12] + own + ws[:12]), 7, "x")]
    got = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, " ".join(ws), 1)], ITEMS)).collect()
    assert {(r.item_id, r.doc_id, r.n_words) for r in got} == {(5, 1, 25), (5, 2, 25)} and len(got) == 2
    texts = {d: t for d, t, *_ in docs}
    assert all(texts[r.doc_id][r.start_pos - 1 : r.end_pos].split() == changed for r in got)


def all_alignments(item, doc):
    """Whether ``doc`` holds a stretch of ``item``: the earliest begin by match and errors, from every match before."""
    most = len(item) // 10
    first = {}
    for i in range(len(item)):
        for j in range(len(doc)):
            if item[i] == doc[j]:
                here = {0: i}
                for (p, q), states in first.items():
                    if p < i and q < j and (gap := max(i - p, j - q) - 1) <= most:
                        for e, a in states.items():
                            if e + gap <= most:
                                here[e + gap] = min(a, here.get(e + gap, i))
                first[i, j] = here
                if any(i - a + 1 >= 20 and 10 * e <= i - a + 1 for e, a in here.items()):
                    return True
    return False


def test_against_all_alignments():
    rnd = random.Random(3)
    seen = []
    for _ in range(300):
        item = rnd.choices(range(1, rnd.choice([3, 8, 200])), k=rnd.randint(20, 34))
        a = rnd.randint(0, 6)
        doc = item[a : a + rnd.randint(17, 26)]
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(doc))
            doc[k : k + rnd.randint(0, 1)] = rnd.choice([[], [0], [0], item[:1]])
        doc = rnd.choice([[], item[:9], [0, 0]]) + doc + rnd.choice([[], [0] * 5 + item[:10], [0]])
        x, y = np.asarray(item), np.asarray(doc)
        grams = [(i, j) for i in range(len(item) - 5) for j in range(len(doc) - 5) if item[i : i + 6] == doc[j : j + 6]]
        found = False
        if grams:
            table = leakage.Items([])
            table.begins, table.words = np.asarray([0, len(item)]), x
            at, places = np.asarray([j for _, j in grams]), np.asarray([i for i, _ in grams])
            items, a, b, n, _ = leakage._runs(at, places, np.zeros(len(grams), np.int64))
            tries = [bool(leakage.stretches(x, y, *r)) for r in zip(a.tolist(), b.tolist(), n.tolist())]
            found = any(tries)
            assert not found or leakage._hopeful(table, y, items, a, b, n).any(), (item, doc)
        assert found == all_alignments(item, doc), (item, doc)
        seen.append(found)
    assert 60 < sum(seen) < 280


def test_each_stretch_of_an_item(spark):
    name = lambda p, k: p + "".join(chr(97 + k // d % 26) for d in (676, 26, 1))
    short, long, own = ([name(p, k) for k in range(n)] for p, n in (("s", 104), ("l", 400), ("o", 30)))
    dense = [w if k % 9 or not k else "other" for k, w in enumerate(short)]  # one word in nine changed: no single stretch
    docs = {
        1: [*short[:30], *own, *short[60:90]],
        2: [*own, *long[100:125], *own[:27], *long[140:165]],
        3: [*short[60:90], *own[:9], *short[:30], *own[:3], *short[40:70], *short],
        4: [*own, *dense, *own],
    }
    texts = {d: " ".join(ws) for d, ws in docs.items()}
    docs_df = spark.createDataFrame([(d, t, 7, "x") for d, t in texts.items()], DOCS)
    items_df = spark.createDataFrame([(1, " ".join(short), 1), (2, " ".join(long), 1)], ITEMS)
    got = {}
    for r in leakage.leaks(docs_df, items_df).collect():
        got.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start_pos - 1 : r.end_pos].split())
    assert sorted(got[1]) == [short[:30], short[60:90]]
    assert sorted(got[2]) == [long[100:125], long[140:165]]
    assert sorted(map(len, got[3])) == [30, 30, 30, 104]
    left = {r.doc_id: r.text.split() for r in leakage.cleaned(docs_df, items_df).collect()}
    assert left[1] == own and left[2] == [*own, *own[:27]]
    assert [w for w in left[3] + left[4] if w not in own] == []


def test_words():
    text = "00:12 Twelve 12 by 30 is 360\n3. l'eau <b>a < b</b> &amp; [01:02:03] it's\n> 4) 会議"
    assert leakage.words(text) == ["twelve", "12", "by", "30", "is", "360", "l'eau", "a", "b", "it's", "会", "議"]
    assert [text[a:b].lower() for a, b in leakage._spans(text)] == leakage.words(text)


def test_text_without_blanks(spark):
    rnd = random.Random(1)
    item = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(60))
    docs = spark.createDataFrame([(1, "前文。" + item[10:40] + "、後", 7, "x"), (2, item[:15], 7, "x")], DOCS)
    got = leakage.leaks(docs, spark.createDataFrame([(5, item, 1)], ITEMS)).collect()
    assert [(r.doc_id, r.start_pos, r.end_pos, r.n_words) for r in got] == [(1, 4, 33, 30)]


def test_shared_wording_and_repeated_items(spark, monkeypatch):
    """Wording that many items share is no leak by itself; the same passage under two ids is one of each."""
    rnd = random.Random(9)
    shared = "by the time the tide had turned the ferry was gone".split()
    items = [(i, " ".join(passage(rnd, 30) + shared + passage(rnd, 30))) for i in range(120)]
    items += [(500, items[3][1]), (3, items[3][1]), (3, items[4][1])]
    docs = [(1, " ".join(shared * 40)), (2, " ".join([*shared, *items[3][1].split()[10:60], *shared])), (3, " ".join(items[7][1].split()[15:38]))]
    docs_df = spark.createDataFrame([(*d, 7, "x") for d in docs], DOCS)
    items_df = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    for hits in (leakage.HITS, 500):
        monkeypatch.setattr(leakage, "HITS", hits)
        got = {(r.item_id, r.doc_id) for r in leakage.leaks(docs_df, items_df).collect()}
        assert got == {(3, 2), (500, 2), (7, 3)}


def test_linear_in_items_of_a_document():
    rnd = random.Random(5)
    table = leakage.Items([(i, " ".join(passage(rnd))) for i in range(800)])

    class Held:
        value = table

    def took(n):
        text = " ".join(" ".join(x) for x in ([list(table.vocabulary)[w - 1] for w in item] for item in table.items[:n]))
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
        t = time.process_time()
        (out,) = leakage._scanner(Held)(iter([batch]))
        assert out.num_rows == n
        return time.process_time() - t

    took(100)
    assert min(took(800) for _ in range(3)) < 3.2 * min(took(400) for _ in range(3))


def test_cleaned_is_what_spans_leave(spark):
    items, docs, _ = build(random.Random(8))
    docs_df, items_df = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    gone = {}
    for r in leakage.leaks(docs_df, items_df).collect():
        gone.setdefault(r.doc_id, set()).add((r.start_pos, r.end_pos))
    texts = {d: t for d, t, *_ in docs}
    want = {(d, "".join(c for k, c in enumerate(texts[d], 1) if not any(a <= k <= b for a, b in spans)), len(spans)) for d, spans in gone.items()}
    assert {tuple(r) for r in leakage.cleaned(docs_df, items_df).collect()} == want
