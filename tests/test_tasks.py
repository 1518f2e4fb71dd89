"""Documents that meet many terms are dealt to counted tasks, however few the files are."""

import pandas as pd
from pyspark.sql import functions as F

from harborline.operators import matching as M
from harborline.operators import relational as O
from harborline.operators import retrieval as V
from harborline.operators import roles as X
from harborline.operators import scoring as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parts(spark, n=300):
    return spark.range(n).coalesce(1).select(F.col("id"), F.lit("b").alias("bucket"), F.concat(F.lit("w"), F.col("id") % 5).alias("x"))


def test_dealt_rows_do_not_fill_one_task(spark):
    assert O.dealt(spark.range(1000).coalesce(1), "id", 10).rdd.getNumPartitions() == 100


def test_roles_with_fallback_stays_in_counted_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_DOCS", 10)
    roles = spark.createDataFrame([("b", f"r{i}", f"w{i % 4}") for i in range(8)], "bucket string, role string, term string")
    got = C.roles_with_fallback(parts(spark), "id", "bucket", "x", roles, 3)
    assert ", 30), REPARTITION_BY_NUM" in plan(got)
    want = {(i, f"r{j}", True) for i in range(300) for j in range(8) if j % 4 == i % 5} | {(i, f"r{j}", False) for i in range(4, 300, 5) for j in range(3)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_substring_attribution_stays_in_counted_tasks(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_DOCS", 10)
    docs = parts(spark).select("id", F.array("bucket").alias("buckets"), F.concat(F.lit("text "), "x").alias("x"))
    terms = spark.createDataFrame([("b", "p", "text"), ("b", "q", "t w1"), ("b", "q", "text")], "bucket string, role string, term string")
    got = X.substring_attribution(docs, "id", "buckets", "x", terms)
    assert ", 30), REPARTITION_BY_NUM" in plan(got)
    rows = {(r.id, r.role): round(r.weight, 6) for r in got.collect()}
    assert rows == {(i, role): 0.5 if i % 5 != 1 else {"p": 0.333333, "q": 0.666667}[role] for i in range(300) for role in "pq"}


def test_jaccard_matches_stays_in_counted_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_PAIRS", 10)
    left = spark.range(300).coalesce(1).select((F.col("id") % 50).alias("k"), F.concat(F.lit("w"), F.col("id") % 3).alias("x"))
    right = spark.createDataFrame([("p", "w0"), ("p", "w1"), ("q", "w2"), ("q", "w2")], "o string, x string")
    got = C.jaccard_matches(left, "k", right, "o", "x")
    assert ", 30), REPARTITION_BY_NUM" in plan(got)
    assert {tuple(r) for r in got.collect()} == {(k, o, n, 1.0) for k in range(50) for o, n in (("p", 2), ("q", 1))}


def test_a_text_is_marked_once_for_all_skills(spark):
    df = spark.createDataFrame([("a b", ["b", "cc c"])], "t string, s array<string>").select(M.skill_hits(F.col("t"), F.col("s")).alias("h"))
    asked = df._jdf.queryExecution().analyzed().toString().lower().split("contains(")[1:]
    assert asked and not any(x.startswith("regexp_replace(") for x in asked)


def test_weak_labels_take_few_texts_at_a_time():
    texts, skills = pd.Series(["the part"] * 600), pd.Series([["part"]] * 600)
    frames = list(M.weak_labels.func(iter([(texts, skills)])))
    assert [len(f) for f in frames] == [250, 250, 100] and all(x == ["O", "B"] for f in frames for x in f["labels"])


def test_events_by_keywords_stays_in_counted_tasks(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_DOCS", 100)
    entities = spark.createDataFrame([("e", "w1"), ("e", "both"), ("f", "w2")], "e string, k string")
    events = parts(spark).select("id", F.concat("x", F.lit(" both")).alias("t"))
    got = X.events_by_keywords(events, "id", "t", entities, "e", "k", 2, [F.col("hits").desc(), F.col("id")], 3)
    assert ", 30), REPARTITION_BY_NUM" in plan(got)
    assert sorted((r.e, r.id, r.hits) for r in got.collect()) == [("e", 1, 2), ("e", 6, 2), ("e", 11, 2)]


def test_dictionary_matches_stay_in_counted_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_DOCS", 100)
    aliases = spark.createDataFrame([("w1", "One"), ("w1 both", "Two")], "alias string, name string")
    got = M.dictionary_matches(parts(spark).select("id", F.concat("x", F.lit(" both")).alias("t")), "id", "t", aliases, 2, 3)
    assert ", 30), REPARTITION_BY_NUM" in plan(got)
    assert {(r.id, tuple(r.names)) for r in got.collect()} == {(i, ("Two",)) for i in range(1, 300, 5)}


def test_bm25_by_group_takes_few_texts_at_a_time(spark):
    docs = spark.createDataFrame([("g", i, ["a", "b"][: 1 + i % 2]) for i in range(4)], "g string, d long, w array<string>")
    asked = spark.createDataFrame([("g", ["b"])], "g string, q array<string>")
    got = V.bm25_by_group(docs, "g", "d", "w", asked, "q", 3)
    assert "MapInArrow" in plan(got) and "MapInPandas" not in plan(got)
    assert [r.d for r in got.orderBy("rank").collect()] == [1, 3]
