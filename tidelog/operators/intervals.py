"""Continuous periods and gaps of overlapping time intervals, for entities of any size.

The merge has two levels. Level one clips every interval into time shards and merges inside each
(entity, shard); level two sees one summary row per (entity, shard) and stitches coverage that
touches shard boundaries. So the sort of a hot entity is spread over its shards, and the only step
that holds an entity in one task is over its shards, whose number is bounded by the time range and
not by the rows. An interval over many shards is kept as a head, a tail and one span of whole shards
between them, so a wrong end years away costs three rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a UTC timestamp, zone-less or not; parts of a millisecond are cut."""
    return F.unix_millis(ts.cast("timestamp"))


def _clipped(intervals: DataFrame, width: int) -> DataFrame:
    """(k, shard, s, e, span): pieces inside a shard; a row with a span covers the shards [shard, span) whole."""
    first, last = F.floor(F.col("s") / F.lit(width)).cast("long"), F.floor((F.col("e") - 1) / F.lit(width)).cast("long")
    none = F.lit(None).cast("long")

    def part(shard: Column, s: Column, e: Column, span: Column = none) -> Column:
        return F.struct(shard.alias("shard"), s.cast("long").alias("s"), e.cast("long").alias("e"), span.alias("span"))

    whole = F.array(part(first, F.col("s"), F.col("e")))
    ends = F.array(part(first, F.col("s"), (first + 1) * width), part(last, last * width, F.col("e")))
    parts = F.when(first == last, whole).when(last == first + 1, ends).otherwise(F.concat(ends, F.array(part(first + 1, none, none, last))))
    return intervals.select("k", F.explode(parts).alias("p")).select("k", "p.*")


def _stitched(df: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """A row (k, shard, s, before, runs_to) for each start of a continuous period.

    ``before`` is where the coverage before it ends (null for a key's first period), ``runs_to``
    where coverage that leaves the shard ends.
    """
    rows = df.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("k is not null and e > s")
    # One end per start: copies and repeated rows vanish in the map-side combine before any sort.
    pieces = _clipped(rows, width).groupBy("k", "shard", "s").agg(F.max("e").alias("e"), F.max("span").alias("span"))
    earlier = Window.partitionBy("k", "shard").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumn("reach", F.max("e").over(earlier))
    by_key = Window.partitionBy("k").orderBy("shard")
    past, later = by_key.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("k").orderBy(F.desc("shard")).rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        local.groupBy("k", "shard")
        .agg(
            F.min("s").alias("first_s"),
            F.greatest(F.max("e"), F.max("span") * width).alias("last_e"),
            F.min(F.when(F.col("s") > F.col("reach"), F.col("reach"))).alias("break_e"),  # end of the first local period, if another follows
            F.max("span").alias("span"),
        )
        .withColumn("cover", F.max("last_e").over(past))
        .withColumn("whole", F.coalesce(F.max("span").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) > F.col("shard"), F.lit(False)))
        .withColumn("stop", F.when(~F.col("whole"), F.when(F.col("first_s") <= F.col("cover"), F.col("break_e")).otherwise(F.col("cover"))))
        .withColumn("runs_to", F.coalesce(F.last("stop", ignorenulls=True).over(later), F.max("last_e").over(Window.partitionBy("k"))))
        .where(~F.col("whole"))
        .select("k", "shard", "cover", "runs_to")
    )
    # A span's row has no start. The test names the span so that both uses of the pieces need the same columns and share one shuffle.
    starts = local.where("span is null and (reach is null or s > reach)").select("k", "shard", "s", "reach")
    before = F.coalesce("reach", "cover")
    return starts.join(shards, ["k", "shard"]).select("k", "shard", "s", before.alias("before"), "reach", "runs_to").where("before is null or s > before")


def gaps(df: DataFrame, key: str, start: str, end: str, width_ms: int = DAY_MS) -> DataFrame:
    """(key, gap_start, gap_end): the gaps between consecutive continuous periods of each key.

    ``start`` and ``end`` are integers (epoch ms). Rows with a null key or bound, or an end not after
    the start, are left out; periods that touch are one; repeated rows count once; a key with one
    period has no gap; an empty table has none. Other columns of ``df`` are not read.
    """
    return _stitched(df, key, start, end, width_ms).where("before is not null").select(F.col("k").alias(key), F.col("before").alias("gap_start"), F.col("s").alias("gap_end"))


def periods(df: DataFrame, key: str, start: str, end: str, width_ms: int = DAY_MS) -> DataFrame:
    """(key, period_start, period_end): the continuous periods of each key; rows as in :func:`gaps`."""
    following = F.lead("reach").over(Window.partitionBy("k", "shard").orderBy("s"))
    return _stitched(df, key, start, end, width_ms).select(F.col("k").alias(key), F.col("s").alias("period_start"), F.coalesce(following, "runs_to").alias("period_end"))
