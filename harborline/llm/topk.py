"""Exact top-k search by integer inner product.

Queries are counted and broadcast in blocks of bounded size; the rows stay where they are, and each task
takes its own in tiles.  Every tile meets the block in one matrix product; a partial selection of the tile's
scores and the task's lists so far leaves the best k of each query; the tasks' lists are merged in a tree,
`fan` of them at a time, so that no merge sees more than fan * k entries of a query.

Vectors that are null, or hold null or non-finite components, and rows without id take no part.  Only vectors of the query's
own length are compared with it.  Repeated rows (same id and vector) count once; a query never meets rows
of its own id; an id with several vectors asks with each, and its list is the best of theirs.  Ties go to the
smaller id.  No queries or no rows: no results.  Columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.common import released, written

LOW = -(1 << 62)  # below every score
EXACT = 2.0**53  # a float64 product is exact while every partial sum stays below this


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    return (
        df.where(_usable(v) & F.col(id_column).isNotNull())
        .select(
            F.col(id_column).cast("long").alias("id"),
            F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"),
            F.size(v).alias("dim"),
        )
        .dropDuplicates(["id", "v"])
    )


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row of scores, and their ids: by score, then by id; LOW where there are fewer."""
    rows, n = scores.shape
    out_scores, out_ids = np.full((rows, k), LOW), np.zeros((rows, k), np.int64)
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(rows, LOW)
    r, c = np.nonzero((scores >= least[:, None]) & (scores > LOW))  # all that reach the k-th score, then by id
    s, i = scores[r, c], ids[r, c]
    order = np.lexsort((i, -s, r))
    r, s, i = r[order], s[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, np.arange(rows))[r]
    good = place < k
    out_scores[r[good], place[good]], out_ids[r[good], place[good]] = s[good], i[good]
    return out_scores, out_ids


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers: in float64 while that is exact."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def exact_top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_block: int = 8192,
    cells: int = 1 << 22,
    fan: int = 16,
) -> DataFrame:
    """Rows (query_id, rank from 1, <id_column>, score) of the k highest scores for each row with is_query.

    query_block: about so many queries are broadcast at a time; cells: scores held at a time in a task.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[id_column]
    rows = written(quantised(df, id_column, vector_column, scale), "topk-rows")
    asked = rows.join(df.where(is_query).select(F.col(id_column).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = written(asked, "topk-queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    schema = "query_id long, s int, id long, score long"
    lists = None
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        by_length: dict[int, list] = {}
        for r in mine.select("id", "v").collect():  # one bounded block
            by_length.setdefault(len(r.v), []).append((r.id, r.v))
        queries = {n: (np.array([i for i, _ in q], np.int64), np.array([v for _, v in q], np.int64).reshape(len(q), n)) for n, q in by_length.items()}
        model = spark.sparkContext.broadcast(queries)

        def best(frames: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            held = {n: (np.full((len(q), k), LOW), np.zeros((len(q), k), np.int64)) for n, (q, _) in model.value.items()}
            for frame in frames:
                length = frame["v"].map(len).to_numpy()
                for n in set(length.tolist()) & held.keys():
                    names, a = model.value[n]
                    part = frame[length == n]
                    ids, b = part["id"].to_numpy(np.int64), np.stack(part["v"].to_list()).astype(np.int64).reshape(len(part), n)
                    step = max(1, cells // len(names))
                    for at in range(0, len(ids), step):
                        here = ids[at : at + step]
                        scores = products(a, b[at : at + step])
                        scores[names[:, None] == here[None, :]] = LOW
                        both = np.concatenate([held[n][0], scores], axis=1)
                        held[n] = best_of(both, np.concatenate([held[n][1], np.broadcast_to(here, scores.shape)], axis=1), k)
            for n, (scores, ids) in held.items():
                r, c = np.nonzero(scores > LOW)
                if len(r):
                    task = TaskContext.get().partitionId()
                    yield pd.DataFrame({"query_id": model.value[n][0][r], "s": np.int32(task), "id": ids[r, c], "score": scores[r, c]})
            released()

        found = rows.select("id", "v").mapInPandas(best, schema)
        lists = found if lists is None else lists.unionByName(found)
    lists = written(lists, "topk-lists")
    order = [F.col("score").desc(), F.col("id")]
    n_s = (lists.agg(F.max("s")).first()[0] or 0) + 1
    while n_s > fan:
        n_s = math.ceil(n_s / fan)
        lists = lists.withColumn("s", F.floor(F.col("s") / fan).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "s").orderBy(*order)))
        lists = lists.where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").cast(kind).alias(id_column), "score")
