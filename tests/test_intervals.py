"""The two-level merge against a plain merge in Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidelog.operators import intervals

COLUMNS = "k string, s bigint, e bigint, shard string, cover int"


def plain(rows):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    periods, gaps = set(), set()
    for k, xs in by.items():
        out = []
        for s, e in sorted(xs):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        periods |= {(k, s, e) for s, e in out}
        gaps |= {(k, a[1], b[0]) for a, b in zip(out, out[1:])}
    return periods, gaps


def run(spark, rows, width):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)
    p = [tuple(r) for r in intervals.periods(df, "k", "s", "e", width).collect()]
    g = [tuple(r) for r in intervals.gaps(df, "k", "s", "e", width).collect()]
    assert len(p) == len(set(p)) and len(g) == len(set(g))
    return set(p), set(g)


def test_random(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        for _ in range(rnd.choice([1, 2, 5, 12])):
            s = rnd.randint(-30, 120)
            rows.append((f"k{k}", s, s + rnd.choice([-2, 0, 1, 2, 3, 9, 10, 11, 20, 47, 80])))
    rows += rows[:40] + [(None, 1, 5), ("k1", None, 5), ("k2", 3, None)]
    for width in (1, 7, 10, 1000):
        assert run(spark, rows, width) == plain(rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(0, 60)), max_size=9))
def test_property(spark, rows):
    assert run(spark, rows, 10) == plain(rows)


def test_empty(spark):
    assert run(spark, [], 10) == (set(), set())


@pytest.mark.parametrize("width", [10, intervals.DAY_MS])
def test_touching_at_a_boundary(spark, width):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 35, 90), ("a", 50, 60), ("a", 90, 95), ("a", 97, 98)]
    assert run(spark, rows, width) == ({("a", 0, 20), ("a", 35, 95), ("a", 97, 98)}, {("a", 20, 35), ("a", 95, 97)})
