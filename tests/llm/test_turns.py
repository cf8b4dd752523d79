"""Turns against a plain loop over each recording, and the grammar on single utterances."""

import random
from datetime import datetime, timedelta

import pytest

from tidelog.llm import turns

NODES = "node_id bigint, lifelog_id string, wearer_id bigint, node_type string, content string, start_time timestamp_ntz, start_offset_ms bigint, speaker_name string, speaker_identifier string, received_at timestamp_ntz, part string, key string, said int"
T0 = datetime(2023, 1, 1)


@pytest.mark.parametrize(
    ("content", "label", "said"),
    [
        ("[00:01:02] Spk 2> Right.", "speaker 2", "Right."),
        ("00:00:33,200 --> S03 - the note", "speaker 3", "The note"),
        ("<00:00:09.600> (0:11) speaker #4 : go", "speaker 4", "Go"),
        ("[music (loud [very])] [Speaker 1] hello [dog barking]", "speaker 1", "Hello"),
        ("Uh, um, er. *typing* ♪ ♪", None, ""),
        ("(door closes) (the old one) left {static} (broken", None, "(the old one) left (broken"),
        ("(people talking in the next room) go on *someone slams the heavy old wooden garden door shut*", None, "Go on"),
        ("2 * 3 and 4 * 5, mei(at)saltwick(dot)test", None, "2 * 3 and 4 * 5, mei(at)saltwick(dot)test"),
        ("I would um, cancel- cancel the — you know — plan", None, "I would cancel the plan"),
        ("You: 10:30 works", "You", "10:30 works"),
        ("hello (00:12) there", None, "Hello there"),
        ("hello 00:12:01 there at 10:30", None, "Hello there at 10:30"),
        ("Maria: hello there", "Maria", "Hello there"),
        ("[0:05] Ana Lopez-Ruiz: so be it", "Ana Lopez-Ruiz", "So be it"),
        ("(speaker 2): hi", "speaker 2", "Hi"),
        ("Note: call him. So contact: me", None, "Note: call him. So contact: me"),
        ("well...", None, "Well..."),
        ("you know...", None, "You know..."),
        ("I mean,", None, "I mean"),
        ("well, I think, you know, it holds", None, "I think it holds"),
        ("um 00:12:01 [cough]", None, ""),
        ("Maybe S3 works", None, "Maybe S3 works"),
        ("", None, ""),
        ("]]> *", None, ""),
        ("[" * 30_000 + "x", None, "[" * 30_000 + "x"),
    ],
)
def test_grammar(content, label, said):
    s, tree = turns.parse(content)
    got = turns.label_of(tree)
    assert (got and got.names) == label and turns.text_of(s, tree) == said
    assert turns.is_said(s, tree) == bool(said)


def test_tree():
    s, tree = turns.parse("[0:01]  S2: um, left  [music (loud [very])] here 00:00:09 go- go on")
    assert [(x.rule, s[x.begin : x.end]) for x in tree.inside] == [
        ("time", "[0:01]"), ("label", "S2:"), ("hesitation", "um,"), ("words", " left "), ("sound", "[music (loud [very])]"), ("words", " here "), ("time", "00:00:09"), ("words", " "), ("restart", "go- "), ("words", "go on"),
    ]
    inner = next(x for x in tree.inside if x.rule == "sound").inside
    assert [(s[x.begin : x.end], [s[y.begin : y.end] for y in x.inside]) for x in inner] == [("(loud [very])", ["[very]"])]
    texts = ["[00:01:02] Spk 2> Right.", "a (b [c} d) e", "(((", "um, well, you know... yes", "♪ la ♪ - so, er, no"]
    for text in texts:  # the parts cover the utterance in order, but for blanks
        s, tree = turns.parse(text)
        assert all(x.end <= y.begin for x, y in zip(tree.inside, tree.inside[1:])) and "".join(s[x.begin : x.end] for x in tree.inside).replace(" ", "") == s.replace(" ", "")


def test_speaker_key():
    same = {turns.speaker_key(x) for x in ("Speaker 2", "SPEAKER_02", "speaker-2", "Spk 2", "S2", " Speaker #2 ", "speaker 2:")}
    assert same == {"speaker 2"}
    assert turns.speaker_key("You:") == turns.speaker_key(" me ") == turns.WEARER
    assert turns.speaker_key("ANA  Lopez:") == turns.speaker_key("Ana Lopez") and turns.speaker_key("speaker ?") is turns.speaker_key(None) is None


def plain(rows, wearers):
    """The turns, and of each its speaker, number of utterances, first offset and text."""
    by, lines, turned = {}, {}, {}
    for r in rows:
        if r[1] is not None and (r[0] not in by or r[9] > by[r[0]][9]):
            by[r[0]] = r
    out = []
    for log in {r[1] for r in by.values()}:
        mine, seq = [r for r in by.values() if r[1] == log], []
        base = [(r[5] - T0) // timedelta(milliseconds=1) - r[6] for r in mine if r[5] and r[6] is not None]
        for r in mine:
            text, tree = turns.parse(r[4] or "")
            label = turns.label_of(tree) and turns.label_of(tree).names
            if r[3].strip().lower() == "blockquote" and turns.is_said(text, tree):
                key = turns.speaker_key(r[7])
                if r[8] == "user" or key and key == turns.speaker_key(wearers.get(r[2])):
                    key = turns.WEARER
                lines[r[0]] = turns.text_of(text, tree)
                at = r[6] if r[6] is not None else (r[5] - T0) // timedelta(milliseconds=1) - max(set(base), key=base.count)
                seq.append((at, r[0], key or turns.speaker_key(label)))
        last, no = "nobody yet", 0
        for at, node, key in sorted(seq, key=lambda x: x[:2]):
            key = key or (last if no else None)
            if not no or key != last:
                no += 1
                out.append([log, no, node, node])
                turned[log, no] = [key, 0, at, []]
            turned[log, no][1] += 1
            turned[log, no][3].append(lines[node])
            out[-1][3], last = node, key
    return {tuple(x) for x in out}, {(*k, *v[:3], " ".join(v[3])) for k, v in turned.items()}


def test_against_plain_loop(spark, monkeypatch):
    rnd = random.Random(6)
    wearers = {1: "Ana Lopez", 2: None}
    rows, node = [], 0
    for log in range(30):
        for _ in range(rnd.choice([1, 3, 25, 60])):
            node += 1
            at = rnd.randint(0, 90) * 1000
            name, ident = rnd.choice([(None, None), ("You", "user"), (None, "user"), ("ana lopez", None), ("Speaker 1", None), ("SPEAKER_01", None), ("Bo", None), ("Unknown", None), (None, None)])
            text = rnd.choice(["Right.", "um...", "[music]", None, "", "Speaker 1: yes", "[0:01] S2 - no", "so be it"])
            start = T0 + timedelta(milliseconds=at + 5000 * log)
            miss = rnd.random()
            rows.append((node, f"r{log}", 1 + log % 2, rnd.choice(["blockquote", "Blockquote ", "heading1"]), text, None if miss < 0.1 else start, None if miss > 0.9 else at, name, ident, T0 + timedelta(days=rnd.randint(0, 3)), "x", "y", 3))
        rows.append((10_000 + log, f"r{log}", 1, "heading1", "title", T0 + timedelta(milliseconds=5000 * log), 0, None, None, T0, "x", "y", 3))
    late = [(*r[:4], "Speaker 1: corrected", *r[5:9], r[9] + timedelta(days=9), *r[10:]) for r in rnd.sample(rows, 40)]
    rows += late + rows[:20] + [(None, None, None, "blockquote", "lost", None, None, None, None, T0, "x", "y", 3)]
    nodes = spark.createDataFrame(rows, NODES)
    people = spark.createDataFrame([*wearers.items(), (1, "Ana Lopez"), (None, "Bo")], "wearer_id bigint, display_name string")
    want, whole = plain(rows, wearers)
    monkeypatch.setattr(turns, "STRETCH_MS", 20_000)
    for stretch in (7_000, 900_000):
        said = turns.numbered(turns.utterances(nodes, people), stretch).collect()
        got = {}
        for r in sorted(said, key=lambda r: r.place):
            got.setdefault((r.lifelog_id, r.turn_no), []).append(r.node_id)
        assert {(*k, v[0], v[-1]) for k, v in got.items()} == want
    assert {tuple(r) for r in turns.bounds(nodes, people).collect()} == want
    assert {tuple(r) for r in turns.turns(nodes, people).collect()} == whole


def test_empty(spark):
    none, people = spark.createDataFrame([], NODES), spark.createDataFrame([], "wearer_id bigint, display_name string")
    assert turns.bounds(none, people).count() == turns.turns(none, people).count() == 0
