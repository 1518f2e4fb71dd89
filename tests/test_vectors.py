"""Cosine search: ties, odd vectors, and no pair of rows in a join."""

import math
import random

import pytest
from pyspark.sql import functions as F

from harborline.operators import retrieval as V


def table(spark, key, name):
    r = random.Random(3)
    base = [[r.uniform(-1, 1) for _ in range(7)] for _ in range(40)]
    rows = [(i, base[i % 40]) for i in range(200)]  # five copies of each
    rows += [(200, None), (201, [1.0, None] + [0.0] * 5), (202, [math.nan] * 7), (203, [0.0] * 7), (204, [1.0, 2.0]), (None, base[0])]
    return spark.createDataFrame(rows, f"{key} long, {name} array<double>")


def by_pairs(spark, queries):
    """(query, item, score) of all pairs by column expressions."""
    a = queries.select("q", V.normalised(F.col("qe")).alias("x"))
    b = table(spark, "id", "e").select("id", V.normalised(F.col("e")).alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return [(r.q, r.id, r.s) for r in a.crossJoin(b).where("q <> id").select("q", "id", dot.alias("s")).collect()]


def height(s):
    return -math.inf if s is None else math.inf if math.isnan(s) else s


@pytest.mark.parametrize(("n", "block", "cells"), [(6, 10_000, 1 << 21), (6, 3, 64), (1000, 10_000, 64)])
def test_cosine_top_is_exact(spark, monkeypatch, n, block, cells):
    monkeypatch.setattr(V, "CELLS", cells)
    queries = table(spark, "q", "qe").where("q % 20 = 0 OR q > 195")
    top = V.cosine_top(table(spark, "id", "e"), "id", "e", queries, "q", "qe", n, most_queries=block)
    assert "NestedLoopJoin" not in top._jdf.queryExecution().toString() and "Cartesian" not in top._jdf.queryExecution().toString()
    want = set()
    pairs = by_pairs(spark, queries)
    for q in {p[0] for p in pairs}:
        mine = sorted((-height(s), i) for k, i, s in pairs if k == q)[:n]
        want |= {(q, i, -s, place) for place, (s, i) in enumerate(mine, 1)}
    got = {(r.q, r.id, height(r.score), r["rank"]) for r in top.collect()}
    assert {(q, i, p) for q, i, _, p in got} == {(q, i, p) for q, i, _, p in want}
    assert got == want


def test_best_similarity_is_the_highest(spark, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 64)
    targets = table(spark, "q", "qe").where("q % 20 = 0")
    best = V.best_similarity(table(spark, "id", "e"), "id", "e", targets, "q", "qe", most_targets=4)
    assert "NestedLoopJoin" not in best._jdf.queryExecution().toString() and "Cartesian" not in best._jdf.queryExecution().toString()
    want = {}
    for q, i, s in by_pairs(spark, targets):
        want[i] = max(want.get(i, -math.inf), height(s))
    got = {r.id: height(r.best) for r in best.collect()}
    assert got == pytest.approx(want)
