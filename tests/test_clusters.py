"""Stratified k-means against separate fits, and sparse vectors against a direct count."""

import hashlib
import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from harborline.operators import clusters as K


def test_all_strata_cost_as_little_as_separate_fits(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumn("b", (F.col("label") % 3).cast("string")).select("vec_id", "b", "embedding")
    rows, centres = K.stratified_clusters(e, "vec_id", "b", "embedding", ["1"])
    cost = {r.b: r.d for r in rows.groupBy("b").agg(F.sum("distance").alias("d")).collect()}
    for b, n, k in [(r.b, r.n, r.k) for r in K.strata_sizes(e, "b", ["1"]).collect()]:
        mine = e.where(F.col("b") == b).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        assert rows.where(F.col("b") == b).count() == n and centres.where(F.col("b") == b).count() == k
        assert cost[b] <= 1.01 * min(KMeans(k=k, seed=s, maxIter=20).fit(mine).summary.trainingCost for s in (1, 2))
    monkeypatch.setattr(K, "MOST_CENTRES", 8)  # strata in several blocks
    again, _ = K.stratified_clusters(e, "vec_id", "b", "embedding", ["1"])
    assert sorted(map(tuple, again.drop("distance").collect())) == sorted(map(tuple, rows.drop("distance").collect()))


def test_small_and_odd_strata(spark):
    rows = [(i, "s", [0.0, float(i % 2)]) for i in range(100)] + [(200, "one", [1.0, 1.0]), (201, None, [1.0, 1.0]), (202, "s", None)] + [(300 + i, "same", [2.0, 2.0]) for i in range(90)]
    found, centres = K.stratified_clusters(spark.createDataFrame(rows, "i int, b string, v array<double>"), "i", "b", "v", [])
    got = {r.i: r for r in found.collect()}
    assert len(got) == 191 and got[200].distance == 0 and all(got[i].cluster == got[i % 2].cluster for i in range(100))
    assert sum(r.n for r in centres.collect()) == 191


def test_sparse_vectors(spark):
    texts = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, []), (4, None), (5, [None, "a"])]
    cell = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % 1000
    got = {r.k: dict(zip(r.cells, r.weights)) for r in K.text_vectors(spark.createDataFrame(texts, "k int, w array<string>"), "k", "w", 1000).collect()}
    df = {w: sum(w in (ws or []) for _, ws in texts) for w in "abc"}
    for k, ws in texts:
        x = {cell(w): ws.count(w) * math.log(6 / (df[w] + 1)) for w in set(ws or []) if w}
        norm = math.sqrt(sum(v * v for v in x.values()))
        assert got[k].keys() == x.keys() and np.allclose([got[k][c] for c in x], [v / norm for v in x.values()])
