"""Nested payloads against a recursive walk in Python, with forms the tables don't have."""

import json
import random

from tidelog.operators import nested
from tidelog.sources import envelopes

DDL = "payload_id bigint, body string, node_path string, lifelog_id int, _v string"


def as_list(v):
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return []
    return [v] if isinstance(v, dict) else v if isinstance(v, list) else []


def walk(payload, log, children, parent=""):
    for i, x in enumerate(as_list(children)):
        if isinstance(x, dict):
            path = f"{parent}.{i}" if parent else str(i)
            yield payload, log, path, parent
            yield from walk(payload, log, x.get("children"), path)


def tree(rnd, depth):
    node = {"type": rnd.choice(["heading1", "blockquote", 7, None]), "content": rnd.choice(["a\"b", "é", None, ""]), "startOffsetMs": rnd.choice([5, "6", None, "x"])}
    if depth and rnd.random() < 0.7:
        kids = [rnd.choice([None, tree(rnd, depth - 1), tree(rnd, depth - 1)]) for _ in range(rnd.randint(0, 3))]
        node["children"] = rnd.choice([kids, kids, json.dumps(kids), kids[0] if kids else {}, None, "cut [", 3])
    return node


def test_against_walk(spark):
    rnd = random.Random(11)
    deep = {"content": "end"}
    for _ in range(60):
        deep = {"children": [None, deep]}
    bodies = []
    for k in range(120):
        logs = [{"id": f"r{k}-{i}", "contents": rnd.choice([[tree(rnd, 4) for _ in range(rnd.randint(0, 3))], json.dumps([tree(rnd, 2)]), tree(rnd, 1), None])} for i in range(rnd.randint(0, 3))]
        data = rnd.choice([{"lifelogs": logs}, logs, {"lifelog": logs[0]} if logs else {}, json.dumps(logs)])
        bodies.append((k, json.dumps({"data": data, "meta": {}}, indent=rnd.choice([None, 2]))))
    bodies += [(900, json.dumps({"data": {"lifelogs": [{"id": "deep", "contents": [deep]}]}}))]
    bad = [(901, None), (902, ""), (903, "{\"data\": [{\"id\""), (904, '{"error": {"message": "no", "code": "RATE"}}'), (905, "[]"), (906, "3"), (907, '{"data": null}')]
    want = set()
    for k, b in bodies:
        data = json.loads(b)["data"]
        if isinstance(data, dict):
            data = data.get("lifelogs", data.get("lifelog"))
        for r in as_list(data):
            want |= set(walk(k, r.get("id"), r.get("contents")))
    df = spark.createDataFrame([(k, b, "p", 1, "v") for k, b in bodies + bad], DDL)
    got = [tuple(r) for r in nested.paths(df, "payload_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    nodes = nested.nodes(df, "payload_id").collect()
    assert {(r.payload_id, r.lifelog_id, r.node_path, r.parent_path) for r in nodes} == want
    assert {r.start_offset_ms for r in nodes} <= {5, 6, None}
    assert sum(r.n_nodes for r in nested.recordings(df, "payload_id").collect()) == len(want)
    assert [(r.payload_id, r.message, r.code) for r in envelopes.errors(df, "payload_id").collect()] == [(904, "no", "RATE")]
    states = {r.state: r.n for r in envelopes.readable(df).collect()}
    assert states["null"] == states["empty"] == states["invalid"] == states["error"] == states["unknown"] == 1


def test_unknown_answers(spark):
    bodies = ['{"rows": [], "at": 3}', "3", '"text"', "{}", "[]", '{"data": null}', '{"error": {}}', '{"contents": []}', "{", "", None]
    df = spark.createDataFrame([(k, b, "p", 1, "v") for k, b in enumerate(bodies)], DDL)
    assert {r.payload_id: r.found for r in envelopes.unknown(df, "payload_id").collect()} == {0: "at,rows", 1: None, 2: None, 3: ""}
    assert {r.state: r.n for r in envelopes.readable(df).collect()} == {"unknown": 4, "data": 3, "error": 1, "invalid": 1, "empty": 1, "null": 1}


def test_empty(spark):
    none = spark.createDataFrame([], DDL)
    assert nested.paths(none, "payload_id").count() == nested.nodes(none, "payload_id").count() == nested.recordings(none, "payload_id").count() == 0


def test_one_recording_as_the_body(spark):
    log = {"id": "r", "contents": [{"content": "a", "children": [None, {"content": "b"}]}]}
    bodies = [log, {"lifelog": log}, {"lifelog": [log]}, {"lifelogs": [log]}, {"contents": log["contents"]}, {"id": "r", "contents": json.dumps(log["contents"])}, {"error": {"message": "no"}}, {}]
    df = spark.createDataFrame([(k, json.dumps(b), "p", 1, "v") for k, b in enumerate(bodies)], DDL)
    got = {tuple(r) for r in nested.paths(df, "payload_id").collect()}
    assert got == {(k, None if k == 4 else "r", path, parent) for k in range(6) for path, parent in (("0", ""), ("0.1", "0"))}
    assert {(r.payload_id, r.lifelog_id, r.n_nodes) for r in nested.recordings(df, "payload_id").collect()} == {(k, None if k == 4 else "r", 2) for k in range(6)}
