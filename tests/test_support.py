"""Vectors, sinks, checkpoints, streams."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import vectors
from tidelog.schema import RECORDING
from tidelog.sources import cut, sinks
from tidelog.streaming import monitor

T0 = datetime(2024, 1, 15, 12)


def test_nearest(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.normal(size=8)], "x") for i in range(300)]
    rows += [(400, rows[0][1], "x"), (401, None, "x"), (402, [0.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    m = np.asarray([r[1] for r in rows[:301]], np.float32).astype(float)
    at = [r[0] for r in rows[:301]]
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for numbers in (vectors.BLOCK_NUMBERS, 8):
        monkeypatch.setattr(vectors, "BLOCK_NUMBERS", numbers)
        got = {}
        for r in vectors.nearest(df, df.where("vec_id % 100 = 0 and vec_id < 300"), 5).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        for q in (0, 100, 200):
            score = np.round(unit @ unit[at.index(q)], 6)
            want = sorted((-s, i) for s, i in zip(score, at) if i != q)[:5]
            assert [v for _, v in sorted(got[q])] == [i for _, i in want]
    assert vectors.nearest(df, df.limit(0), 5).count() == 0
    monkeypatch.setattr(vectors, "MOST_BLOCKS", 1)
    with pytest.raises(ValueError, match="blocks"):
        vectors.nearest(df, df, 5)


def recordings(spark, n):
    rnd = random.Random(2)
    return [(f"r{i}", 1, rnd.choice(["Budget, \"x\"", None, "a\nb"]), rnd.choice(["the budget", None, "none"]), T0 + timedelta(hours=9 * i), None, T0 + timedelta(hours=i)) for i in range(n)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(recordings(spark, 20), RECORDING)
    untimed = df.limit(3).withColumn("start_time", F.lit(None).cast("timestamp_ntz"))
    busy = spark.createDataFrame([(f"x{i}", 1, None, None, T0, None, T0) for i in range(40)], RECORDING)
    every = df.union(untimed).union(busy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else a few rows are put together again
    sinks.write_by_day(every, str(tmp_path / "days"), rows_a_file=10)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "days/year=2024/month=1/day=15").glob("*.parquet"))) > 1
    back = spark.read.parquet(str(tmp_path / "days")).drop("year", "month", "day").select(every.columns)
    assert back.exceptAll(every).count() == every.exceptAll(back).count() == 0
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.schema(RECORDING).json(str(tmp_path / "json")).exceptAll(df).count() == 0
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = sinks.read_csv(spark, str(tmp_path / "csv"), RECORDING)
    assert sorted(r.id for r in back.collect()) == sorted(r.id for r in df.collect())
    sinks.write_text(df.selectExpr("id as text"), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).where("value <> ''").count() == 20


def test_checkpoints_need_a_shared_folder(spark):
    assert cut(spark.range(3)).count() == 3
    unset = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))
    context = SimpleNamespace(_jsc=unset, getConf=dict, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)))


def test_entry_without_the_subpackage(monkeypatch, capsys):
    """A library that only the subpackage needs may be absent."""
    import __spark_entry__ as entry

    def absent(name):
        raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")

    monkeypatch.setattr(entry.importlib, "import_module", absent)
    assert "p1_found" in entry.queries() and "p3_found" not in entry.queries() and "ahocorasick" in capsys.readouterr().err


def test_watch_of_later_deliveries(spark, tmp_path):
    """A term that only the complete delivery has comes out, and each term once."""
    rows = [("a", 1, "Budget", None, T0, None, T0), ("a", 1, "Budget", "the plan", T0, None, T0 + timedelta(hours=1)), ("a", 1, "Budget", "the plan", T0, None, T0 + timedelta(hours=2))]
    seen = []
    for k, row in enumerate(rows):
        spark.createDataFrame([row], RECORDING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = monitor.watched(monitor.arriving(spark, str(tmp_path / "in"), RECORDING), ["budget", "plan"])
        monitor.started(stream, lambda df, _: seen.extend((r.id, r.term) for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == [("a", "budget"), ("a", "plan")]


def test_stream(spark, tmp_path):
    rows = recordings(spark, 12)
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame(rows[:6], RECORDING).coalesce(1).write.parquet(source)
    new = monitor.arriving(spark, source, RECORDING)
    run = lambda: monitor.started(monitor.watched(new, ["budget", "never"]), lambda df, _: seen.extend((r.id, r.term) for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    run()
    spark.createDataFrame(rows[3:], RECORDING).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(seen) == sorted((r[0], "budget") for r in rows if "budget" in f"{r[2]} {r[3]}".lower())


def test_replayed(spark, tmp_path):
    """A table as one file or a folder of files, with new rows in some, and an empty one."""
    df = spark.createDataFrame(recordings(spark, 12), RECORDING)
    df.repartition(3).write.parquet(str(tmp_path / "lifelogs.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "empty.parquet"))
    stream = lambda name: monitor.watched(monitor.table_arriving(spark, str(tmp_path), name, RECORDING), ["budget"], lateness="3650 days")
    assert sorted(r.id for r in monitor.replayed(stream("lifelogs")).collect()) == sorted(r.id for r in df.collect() if "budget" in f"{r.title} {r.markdown}".lower())
    assert monitor.replayed(stream("empty")).count() == 0
    counted = monitor.replayed(monitor.by_window(monitor.table_arriving(spark, str(tmp_path), "lifelogs", RECORDING), width="4 hours"), "complete")
    assert [r.n for r in counted.orderBy("start").collect()] == [4, 4, 4]


def test_stream_windows(spark, tmp_path):
    rows = [*recordings(spark, 12), ("late", 1, None, None, T0, None, T0 + timedelta(days=9))]
    spark.createDataFrame(rows, RECORDING).coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = []
    stream = monitor.by_window(monitor.arriving(spark, str(tmp_path / "in"), RECORDING), width="4 hours")
    monitor.started(stream, lambda df, _: counts.extend(r.n for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert counts == [4, 4, 4]
