"""Nearest vectors of a set of queries, exact, in blocks; joined with records, and fused with text search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import recall as R

#: Queries that are sent to all tasks at a time; a larger set is searched in several passes.
BLOCK = 50_000
ROWS, COLUMNS = 2048, 512


def nearest_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """(query_id, key, dist, rank): the k nearest vectors of every query, itself included; ties by key.

    ``metric`` is 'l2' (Euclidean distance) or 'cosine' (1 - cosine). Every task keeps the
    k best of its rows for each query, so what is shuffled does not grow with a task's
    rows. Null and empty vectors take no part, nor do vectors of another length than the
    query's; a zero vector is at cosine distance 1 from all.
    """
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")).where("k is not null and size(v) > 0")
    asked = queries.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")).where("k is not null and size(v) > 0").dropDuplicates(["k"])
    n_blocks = max(1, -(-asked.count() // block))
    out = None
    for i in range(n_blocks):
        mine = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("k"), F.lit(n_blocks)) == i)
        found = rows.mapInArrow(_search(vectors.sparkSession.sparkContext.broadcast(mine.toArrow()), k, metric), "query_id long, k long, dist double")
        best = F.slice(F.array_sort(F.collect_list(F.struct("dist", "k"))), 1, k)
        found = found.groupBy("query_id").agg(best.alias("x")).select("query_id", F.posexplode("x").alias("pos", "x"))
        found = found.select("query_id", F.col("x.k").alias(key), "x.dist", (F.col("pos") + 1).alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out


def _search(shared, k: int, metric: str):
    def matrix(column) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        table = shared.value.combine_chunks()
        q_id = table.column(0).to_numpy()
        if not len(q_id):
            return
        size, flat = matrix(table.column(1).combine_chunks())
        places = np.cumsum(size) - size
        for dim in np.unique(size):
            who = np.flatnonzero(size == dim)
            groups[int(dim)] = q_id[who], np.stack([flat[p : p + dim] for p in places[who]])
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(0).to_numpy()
                n, x = matrix(part.column(1))
                begin = np.cumsum(n) - n
                for dim, (qs, q) in groups.items():
                    mine = np.flatnonzero(n == dim)
                    if len(mine):
                        v = np.stack([x[p : p + dim] for p in begin[mine]])
                        for lo in range(0, len(q), COLUMNS):
                            d = _distances(q[lo : lo + COLUMNS], v, metric)
                            _keep(best, (dim, lo), d, ids[mine], k)
        for (dim, lo), (d, ids) in best.items():
            qs = groups[dim][0][lo : lo + COLUMNS]
            held = ids >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, held.sum(1))), pa.array(ids[held]), pa.array(d[held])], ["query_id", "k", "dist"])

    return run


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        return 1 - np.where(norm > 0, (q @ v.T) / np.where(norm > 0, norm, 1), 0)
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T), 0))


def _keep(best: dict, at, d: np.ndarray, ids: np.ndarray, k: int) -> None:
    ids = np.broadcast_to(ids, d.shape)
    if at in best:
        d, ids = np.concatenate([best[at][0], d], 1), np.concatenate([best[at][1], ids], 1)
    order = np.lexsort((ids, np.where(ids < 0, np.inf, d)), axis=1)[:, :k]
    best[at] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def with_vectors(records: DataFrame, vectors: DataFrame, on: str, vec_key: str = "vec_id") -> DataFrame:
    """Records with their vectors (inner join)."""
    return records.join(vectors.withColumnRenamed(vec_key, on), on)


def hybrid(text: DataFrame, vector: DataFrame, key: str, weights: tuple[float, float] = (0.6, 0.4), boost: Column | None = None, k: int = 60) -> DataFrame:
    """(key, score, position) of two ranked lists (``key``, ``rank``) fused by reciprocal ranks; if one is empty the order of the other stays."""
    fused = R.reciprocal_rank_fusion([(text, weights[0]), (vector, weights[1])], key, None, k)
    sides = text.select(key, F.lit(1).alias("t"), F.lit(0).alias("v"), "rank").unionByName(vector.select(key, F.lit(0).alias("t"), F.lit(1).alias("v"), "rank"))
    by = sides.groupBy(key).agg(F.min("rank").alias("rank"), F.max("t").alias("t"), F.max("v").alias("v"))
    every = Window.partitionBy()  # two lists of bounded length
    rows = fused.join(by, key).withColumn("both", (F.max("t").over(every) == 1) & (F.max("v").over(every) == 1))
    rows = rows.withColumn("score", F.round(F.when(F.col("both"), F.col("rrf") * (boost if boost is not None else 1.0)).otherwise(-F.col("rank").cast("double")), 9))
    return rows.select(key, "score", F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("position"))
