"""Edge cases of the operators outside the plans."""

import random
import zipfile

from pyspark.sql import functions as F

from harborline.functions import normalise as N
from harborline.operators import graphs as G
from harborline.operators import relational as O
from harborline.operators import series as S
from harborline.operators import signals as T2
from harborline.sources import tables as T
from harborline.streaming import incremental as I


def test_stamps_that_do_not_parse_are_null(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), ("2020-13-40",)], "s string")
    assert [r[0] for r in df.select(N.timestamp_of(F.col("s"))).collect()] == [None] * 4


def test_listed_takes_json_and_semicolons(spark):
    df = spark.createDataFrame([('["a ", ""]',), (" a;; b ",), (None,), ("[bad",)], "s string")
    assert [r[0] for r in df.select(N.listed(F.col("s"))).collect()][:3] == [["a"], ["a", "b"], None]


def test_carried_value_only_after_the_cut(spark):
    rows = [("a", 0, 1, 5.0), ("a", 1, None, None), ("a", 2, 2, 0.7), ("a", 3, None, None)]
    df = spark.createDataFrame(rows, "role string, time_idx int, n int, x double")
    got = {r.time_idx: (r.observed, r.x) for r in S.carried(df, "role", "n", "x").collect()}
    assert got == {0: (True, 5.0), 1: (True, 0.0), 2: (True, 0.7), 3: (False, 0.7)}


def test_decay_steps(spark):
    df = spark.range(1, 9).select(S.decay(F.col("id")).alias("d"))
    assert [r.d for r in df.collect()] == [1.0, 1.0, 1.0, 0.75, 0.5, 0.25, 0.0, 0.0]


def test_upsert_takes_the_first_in_order(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    got = sorted(tuple(r) for r in O.upsert(base, new, ["k"], [F.col("v").desc()]).collect())
    assert got == [(1, "a"), (2, "y"), (3, "z")]


def test_zipped_news(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.gkg.csv.zip", "w") as z:
        z.writestr("one.csv", b"20200101\tA;B\t1.5,2\n20200102\t\xff\n")
    rows = T.read_zipped_news(spark, str(tmp_path / "*.zip"), ["day", "themes", "tone"]).collect()
    assert [tuple(r) for r in rows] == [("20200101", "A;B", "1.5,2"), ("20200102", "�", None)]


def test_discovery_needs_a_title_and_more(spark):
    assert T.posting_columns(spark.createDataFrame([], "Title string, job_summary string, job_title string, pay double")) == {"title": "Title", "description": "job_summary", "salary": "pay"}
    assert T.posting_columns(spark.createDataFrame([], "title string, text string")) is None
    assert T.read_any(spark, "x.pdf") is None


def test_levels_and_costs_have_no_depth(spark):
    chain = [(i, i + 1, 1.0) for i in range(15)] + [(0, 9, 20.0), (20, 21, 1.0), (21, 20, 1.0)]
    edges = spark.createDataFrame(chain, "src long, dst long, cost double")
    nodes = spark.createDataFrame([(i,) for i in (*range(16), 20, 21)], "node long")
    assert {r.node: r.level for r in G.levels(edges.select("src", "dst"), nodes).collect()} == {i: i for i in range(16)}
    start = nodes.where("node = 0").withColumn("cost", F.lit(0.0))
    assert {r.node: r.cost for r in G.cheapest(edges, start).collect()} == {i: float(i) for i in range(16)}


def test_graph_plans_take_all_nodes(spark):
    from harborline.plans import assembled, scoring

    small, more = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
    parts = {r[0] for r in spark.read.parquet(f"{small}/part.parquet").select("p_partkey").collect()}
    assert {r.dst for r in scoring.R.queries["p14_non_edges"](spark, small).select("dst").collect()} <= parts
    ordered = assembled.R.queries["p09_topological_order"](spark, more)
    assert ordered.count() == spark.read.parquet(f"{more}/part.parquet").count()


def test_renumbered_counts_every_row_of_a_large_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    got = O.renumbered(rows, order, "", 1).select(F.col("id").cast("long").alias("id")).agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (600_000, 600_000, 1, 600_000)


def test_running_aggregate_over_batches_late_rows_and_restarts(spark, tmp_path):
    schema = "k string, ts timestamp, v int"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(rows):
        df = spark.createDataFrame(rows, "k string, t string, v int").select("k", F.col("t").cast("timestamp").alias("ts"), "v")
        df.coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = I.files(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, 1)
        rows = I.running_aggregate(stream, "ts", "1 day", "1 day", ["k"], [F.count("*").alias("n"), F.sum("v").alias("s")], out, state)
        return {(r.k, r.start.day): (r.n, r.s) for r in rows.collect()}

    arrive([("a", "2024-01-01 10:00:00", 1), ("b", "2024-01-01 11:00:00", 5)])
    arrive([("a", "2024-01-01 23:00:00", 2), ("a", "2024-01-02 01:00:00", 7)])
    assert run() == {("a", 1): (2, 3), ("b", 1): (1, 5), ("a", 2): (1, 7)}
    assert run() == {("a", 1): (2, 3), ("b", 1): (1, 5), ("a", 2): (1, 7)}  # nothing new
    arrive([("a", "2024-01-02 03:00:00", 1), ("a", "2024-01-09 03:00:00", 4)])  # joins its window; moves the watermark
    assert run() == {("a", 1): (2, 3), ("b", 1): (1, 5), ("a", 2): (2, 8), ("a", 9): (1, 4)}
    arrive([("a", "2024-01-01 04:00:00", 100), ("b", "2024-01-09 04:00:00", 1)])  # the first is too late
    assert run() == {("a", 1): (2, 3), ("b", 1): (1, 5), ("a", 2): (2, 8), ("a", 9): (1, 4), ("b", 9): (1, 1)}


def test_percentile_brackets_to_few_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5000), rng.integers(0, 7, 5000).astype(float), np.array([4.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(4)
        for share in (0.0, 0.31, 0.6, 1.0):
            assert abs(G.percentile_of(df, "x", share, few=50) - np.quantile(values, share)) < 1e-9
    assert G.percentile_of(df.limit(0), "x", 0.5) is None


def test_clusters_of_the_sampled_rows_are_tight(spark):
    from harborline.plans import assembled

    folder = "/root/testdata/sf0.001"
    got = assembled.R.queries["r20_stratified_clusters"](spark, folder)
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    rows = e.join(got, "vec_id")
    spread = lambda keys: rows.groupBy(*keys, "p").agg((F.var_pop("x") * F.count("*")).alias("v")).agg(F.sum("v")).first()[0]
    assert spread(["bucket", "cluster"]) < 0.98 * spread(["bucket"]) and got.count() == got.select("vec_id").distinct().count()


def smoothed_by_loop(raw):
    if len(raw) < 6:
        return raw
    head = sorted(raw[:12])
    base = (head[(len(head) - 1) // 2] + head[len(head) // 2]) / 2
    base = base if base >= 0.01 else sum(head) / len(head)
    dips = [i for i, x in enumerate(raw) if x < 0.6 * base]
    out, new = list(raw), 0.6 if dips else 0.7
    if dips:
        a, z = dips[0], dips[-1] + 1
        pre = raw[max(0, a - 3) : a] or raw[:1]
        pre = sum(pre) / len(pre)
        post = raw[z : z + 3]
        post = sum(post) / len(post) if post else 0.9 * pre
        for i in range(a, z):
            out[i] = pre + (post - pre) * (i - a) / (z - a)
    means = out[:1]
    for x in out[1:]:
        means.append(new * x + (1 - new) * means[-1])
    if dips:
        for i in range(1, len(means)):
            last = means[i - 1]
            if last > 0.02:
                means[i] = min(max(means[i], last * 0.85), last * 1.15)
    return [round(min(1.0, max(0.0, x)), 6) for x in means]


def test_smoothing_by_a_direct_loop(spark):
    rng = random.Random(8)
    curves = [[], [0.5] * 5, [0.5] * 6, [0.001, 0.0, 0.002, 0.0, 0.5, 0.0, 0.001], [0.0] * 12, [1.4] * 20, [0.1, 0.9] * 9]
    curves += [[0.7] * 17 + [0.2] * 5 + [0.6] * 14, [0.7] * 30 + [0.1] * 6, [0.1] * 3 + [0.8] * 20, [0.5] * 12 + [0.1] + [0.5] * 5 + [0.1] + [0.9] * 3]
    curves += [[rng.random() for _ in range(rng.randint(6, 40))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(curves)] + [(-1, None), (-2, [0.5, None] * 4)], "i int, c array<double>")
    got = {r.i: r.s for r in df.select("i", S.smoothed("c").alias("s")).collect()}
    for i, c in enumerate(curves):
        assert len(got[i]) == len(c) and all(abs(a - b) < 2e-6 for a, b in zip(got[i], smoothed_by_loop(c))), i
    assert got[-1] is None and got[-2] == [0.5, None] * 4


def test_summary_of_a_forecast(spark):
    rows = [("a", i, 0.5 + i / 100, 0.9, "up", True) for i in range(1, 25)] + [("b", i, 0.5, 0.8, "down", i > 3) for i in range(1, 25)] + [("c", 1, 0.5, 0.7, "up", False)]
    f = spark.createDataFrame(rows, "role string, step int, v double, c double, d string, ready boolean")
    now = spark.createDataFrame([("c", 0.44)], "role string, current double")
    got = {r.role: tuple(r)[1:] for r in T2.forecast_summary(f, "role", "step", "v", "c", now, 24, "d", "ready").collect()}
    assert got["a"] == (round(sum(0.5 + i / 100 for i in range(19, 25)) / 6, 6), "up", 0.9)
    assert got["b"] == (0.5, "flat", 0.8) and got["c"] == (0.5, "up", 0.7)
    short = {r.role: tuple(r)[1:] for r in T2.forecast_summary(f, "role", "step", "v", "c", now, 12, "d").collect()}
    assert short["b"] == (0.5, "down", 0.8) and short["c"] == (0.5, "up", 0.7)


def test_renumbered_query_cuts_like_its_sql(spark):
    import duckdb

    from harborline.plans import relations

    part = spark.range(1_000_002).select(F.col("id").alias("p_partkey"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"))
    got = relations.renumbered(lambda _: part).where("p_partkey >= 999998").collect()
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT range AS p_partkey, 't' AS p_type, 1 AS p_size FROM range(1000002)")
    want = con.sql(f"SELECT * FROM ({relations.R.oracle['s08_renumbered']}) WHERE p_partkey >= 999998").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    whole = O.renumbered(part, [F.col("p_partkey")], "R", 6)
    assert whole.where("p_partkey = 1000001").first().id == "R1000002"
