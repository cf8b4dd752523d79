"""Nearest vectors by cosine, and ranks fused from several searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a block of query vectors that is broadcast at once, at most (64 MB), and blocks of one call.
BLOCK_NUMBERS, MOST_BLOCKS = 8_000_000, 64


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): for each query its ``k`` nearest other vectors by cosine.

    Queries go out in blocks of a bounded size, of which the driver holds one at a time; more than
    MOST_BLOCKS are refused, to be asked for in several calls. Each task keeps the best ``k`` of its own
    rows for each query, so k rows a query and task are shuffled. Scores are rounded to 6 places, ties go
    to the smaller id; null and zero vectors are left out.
    """
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(id).cast("long"), vector)
    width = rows.agg(F.max(F.size(vector)), F.count(F.lit(1))).first()
    if not width[1]:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank bigint")
    blocks = -(-width[0] * width[1] // BLOCK_NUMBERS)
    if blocks > MOST_BLOCKS:
        raise ValueError(f"{width[1]} queries are more than {MOST_BLOCKS} blocks")
    corpus = vectors.where(F.col(vector).isNotNull()).select(F.col(id).cast("long"), F.col(vector).cast("array<double>"))
    found = None
    for b in range(blocks):
        block = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(id), F.lit(blocks)) == b)).collect()
        held = vectors.sparkSession.sparkContext.broadcast((np.asarray([r[0] for r in block]), np.asarray([r[1] for r in block], float).reshape(len(block), -1)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            norm = np.linalg.norm(q, axis=1)
            ones = np.zeros((k, len(ids)), np.int64)  # the best so far, a column a query
            best = np.full((k, len(ids)), -np.inf)
            for batch in batches:
                mine = batch.column(0).to_numpy()
                m = np.asarray(batch.column(1).to_pylist(), float).reshape(len(mine), -1)
                length = np.linalg.norm(m, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.round(m @ q.T / length[:, None] / norm[None, :], 6)
                score[~np.isfinite(score) | (mine[:, None] == ids[None, :])] = -np.inf
                score, names = np.vstack([best, score]), np.vstack([ones, np.broadcast_to(mine[:, None], (len(mine), len(ids)))])
                least = np.partition(score, len(score) - k, axis=0)[-k]  # ties with the k-th are all looked at
                row, query = np.nonzero((score >= least) & np.isfinite(score))
                order = np.lexsort((names[row, query], -score[row, query], query))
                row, query = row[order], query[order]
                place = np.arange(len(row)) - np.searchsorted(query, query)
                row, query, place = (x[place < k] for x in (row, query, place))
                ones, best = np.zeros_like(ones), np.full_like(best, -np.inf)
                ones[place, query], best[place, query] = names[row, query], score[row, query]
            query, place = np.nonzero(np.isfinite(best.T))
            yield pa.RecordBatch.from_arrays([pa.array(ids[query], pa.int64()), pa.array(ones[place, query], pa.int64()), pa.array(best[place, query], pa.float64())], names=["query_id", "vec_id", "score"])

        part = corpus.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def fused(searches: list[DataFrame], constant: int = 60) -> DataFrame:
    """(id, score): results (id, rank) of several searches by the sum of 1 / (constant + rank), rounded to 9 places."""
    parts = [s.select("id", (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("part")) for s in searches]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"))
