"""Grouped features and quantiles against direct computations."""

import random
import statistics

from pyspark.sql import functions as F

from harborline.operators import aggregates as A
from harborline.operators import relational as O


def test_grouped_quantile(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b", "c"]), rng.choice([1, 2]), rng.choice([None, 1.5, 1.5, rng.random()])) for _ in range(900)] + [("none", 1, None), ("one", 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(7)
    got = {(r.k, r.j): r.q for r in O.grouped_quantile(df, ["k", "j"], "v", 0.5, "q").collect()}
    groups = {}
    for k, j, v in rows:
        if v is not None:
            groups.setdefault((k, j), []).append(v)
    assert got.keys() == groups.keys() and all(abs(got[g] - statistics.median(v)) < 1e-12 for g, v in groups.items())
    high = {r.k: r.q for r in O.grouped_quantile(df, ["k"], "v", 0.9, "q").collect()}
    for k in ("hot", None):
        v = sorted(x for (g, _), xs in groups.items() if g == k for x in xs)
        at = 0.9 * (len(v) - 1)
        assert abs(high[k] - (v[int(at)] + (v[int(at) + 1] - v[int(at)]) * (at - int(at)))) < 1e-12
    assert O.grouped_quantile(df.limit(0), ["k"], "v").count() == 0


def test_posting_features_of_odd_rows(spark):
    rows = [("r", "a ", 10.0, "Remote", "Bachelor, MASTER", 2.0, 5, "s", "2020-01-01"), ("r", " ", None, None, None, None, None, None, "2020-01-01"), ("r", "b", 20.0, "x", "master", 4.0, 10, "s", "2020-02-01")]
    df = spark.createDataFrame(rows, "role string, c string, pay double, w string, e string, y double, h int, s string, m string").withColumn("m", F.to_date("m"))
    found = A.posting_features(df, ["role"], "c", "pay", F.lower("w") == "remote", "e", "y", F.col("h"), "s", F.to_date(F.lit("2020-02-09")), "m").first()
    assert (found.job_post_count, found.unique_company_count, found.avg_salary, found.median_salary, found.source_count) == (2, 1, 10.0, 10.0, 1)
    assert (found.remote_share, found.bachelor_share, found.master_share, found.avg_years, found.hit_rate) == (0.5, 0.5, 0.5, 2.0, 0.25)


def test_vocabulary_takes_the_first(spark):
    rows = [(1, "a-b", "Name", ["X"]), (2, "a-b", "Other", ["z"]), (3, "c", "name", ["x", "C"]), (4, "d", "D", None)]
    kept, conflicts = A.vocabulary_conflicts(spark.createDataFrame(rows, "o int, id string, name string, a array<string>"), "o", "id", "name", "a")
    assert {r.alias: r.id for r in kept.collect()} == {"name": "a-b", "a b": "a-b", "a-b": "a-b", "x": "a-b", "c": "c", "d": "d"}
    assert sorted(map(tuple, conflicts.collect()), key=repr) == [("dup_alias", "c", "name", "a-b"), ("dup_alias", "c", "x", "a-b"), ("dup_id", "a-b", None, "a-b")]
