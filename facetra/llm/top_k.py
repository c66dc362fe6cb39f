"""Exact top-k inner products by a three-phase uniform threshold.

The score of a vector is a sum over lists, one list for each block of dimensions. Every
task holds rows of all lists. For a block of queries:

1. each task gathers, per query and list, the k best local scores, and resolves those
   few rows; the k-th best score over all tasks is a score that k rows surely reach;
2. that cutoff is broadcast. A row below ``cutoff / lists`` in every list cannot reach it,
   so each task collects only rows that reach this uniform threshold in some list, and
   drops those whose upper bound (known local scores, plus the threshold for the others)
   is still below the cutoff;
3. the scores of the remaining rows are resolved exactly, and each task keeps its k best.

Queries are dealt to blocks of bounded size; a block is what the driver holds and
broadcasts. The vectors never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

QUERIES_AT_ONCE = 8_192
TILE = 256
LISTS = 4


def scaled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``row``, ``id`` and ``ints``: floor(scale * x) of every component, x as double.

    ``row`` is a number of the row's own, fixed by writing the table. Rows whose key or vector
    is null, or whose vector holds null or non-finite components, are left out. Rows that
    repeat a key, with the same or another vector, are rows of their own.
    """
    doubles = vectors.select(column(key).cast("long").alias("id"), column(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = doubles.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    ints = F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("ints")
    return written(usable.select(F.monotonically_increasing_id().alias("row"), "id", ints), "scaled")


def _matrix(ints, width: int) -> np.ndarray:
    return np.array([v for v in ints], np.int64).reshape(len(ints), width)


def _exact_type(largest: int, other: int, width: int):
    """The fastest number type in which inner products of such integers are exact."""
    bound = int(largest) * int(other) * max(1, width)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` largest values in each column; a row of the result per rank."""
    if len(scores) <= k:
        return np.tile(np.arange(len(scores))[:, None], (1, scores.shape[1]))
    return np.argpartition(-scores, k - 1, axis=0)[:k]


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    lists: int = LISTS,
    queries_at_once: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """For each query the ``k`` rows of highest score, ties to the smaller id.

    Both inputs have ``row`` and ``id`` long and ``ints`` array<long>, as ``scaled`` returns them.
    Only the query's own row is no candidate: rows that repeat its id are, and each of them is a
    query of its own where it is among the queries. Fewer than ``k`` candidates are all returned.
    Only rows as long as the query are compared. Returns ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score``. Empty inputs give no rows.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, math.ceil(n / queries_at_once))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        held = dealt.filter(F.col("block") == block).select("row", "id", "ints").toPandas() if n else pd.DataFrame({"row": [], "id": [], "ints": []})
        for width, same in held.groupby(held["ints"].map(len)):
            if width:
                parts.append(_block_top_k(vectors.filter(F.size("ints") == int(width)), same, int(width), k, lists))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block_top_k(vectors: DataFrame, held: pd.DataFrame, width: int, k: int, lists: int) -> DataFrame:
    spark = vectors.sparkSession
    cuts = np.array_split(np.arange(width), min(lists, width))
    numbers = held["row"].to_numpy(np.int64)
    ids = held["id"].to_numpy(np.int64)
    wanted = _matrix(held["ints"], width)
    queries = spark.sparkContext.broadcast((numbers, ids, wanted))

    def tiles(pdf: pd.DataFrame):
        """Local scores, list by list, of the rows against some queries at a time."""
        numbers, ids, wanted = queries.value
        own = pdf["id"].to_numpy(np.int64)
        place = pdf["row"].to_numpy(np.int64)
        rows = _matrix(pdf["ints"], width)
        kind = _exact_type(np.abs(rows).max(), np.abs(wanted).max(), width)
        rows = rows.astype(kind)
        for at in range(0, len(ids), TILE):
            some = slice(at, at + TILE)
            local = [rows[:, c] @ wanted[some][:, c].astype(kind).T for c in cuts]
            mine = place[:, None] == numbers[None, some]
            yield own, pd.DataFrame({"query": numbers[some], "query_id": ids[some]}), some, local, mine

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            for own, asked, _, local, mine in tiles(pdf):
                total = sum(local).astype(np.float64 if local[0].dtype == np.float32 else local[0].dtype)
                lowest = np.iinfo(np.int64).min if total.dtype == np.int64 else -np.inf
                picked = np.concatenate([_best(np.where(mine, lowest, part), k) for part in local])
                q = np.broadcast_to(np.arange(len(asked)), picked.shape)
                q, r = np.unique(np.stack([q.ravel(), picked.ravel()]), axis=1)
                keep = ~mine[r, q]
                q, r = q[keep], r[keep]
                order = np.lexsort((-total[r, q], q))
                q, r = q[order], r[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, r = q[rank < k], r[rank < k]
                yield asked.iloc[q].assign(vec_id=own[r], score=total[r, q].astype(np.int64))

    shape = "query long, query_id long, vec_id long, score long"
    first = vectors.mapInPandas(gathered, shape)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    reached = first.withColumn("place", place).filter(F.col("place") == k).select("query", "score").toPandas()
    cutoff = pd.Series(reached["score"].to_numpy(), index=reached["query"]).reindex(numbers)
    least = np.iinfo(np.int64).min // 4  # fewer than k candidates: take all
    safe = spark.sparkContext.broadcast(np.array([least if pd.isna(x) else int(x) for x in cutoff], np.int64))

    def resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            for own, asked, some, local, mine in tiles(pdf):
                floor = safe.value[some]
                uniform = floor / len(local)  # below it in every list: below the cutoff in sum
                seen = [part >= uniform for part in local]
                bound = sum(np.where(s, part, uniform) for s, part in zip(seen, local))
                slack = 1e-9 * np.abs(floor) + 1e-6
                r, q = np.nonzero((np.logical_or.reduce(seen)) & (bound >= floor - slack) & ~mine)
                score = sum(part[r, q].astype(np.int64) for part in local)
                keep = score >= floor[q]
                r, q, score = r[keep], q[keep], score[keep]
                order = np.lexsort((own[r], -score, q))
                r, q, score = r[order], q[order], score[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                top = rank < k
                yield asked.iloc[q[top]].assign(vec_id=own[r[top]], score=score[top])

    found = vectors.mapInPandas(resolved, shape)
    ranked = found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
    return written(ranked.select("query_id", "rank", "vec_id", "score"), "top-k")
