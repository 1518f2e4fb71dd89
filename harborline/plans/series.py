"""Panels and series over orders by priority and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators import series as S
from harborline.plans.registry import Registry, Tables
from harborline.plans.relations import MONTHLY, monthly

R = Registry()
#: A sparse series: only some months have rows.
SPARSE_SQL = f"(SELECT role, month, n, total FROM {MONTHLY} WHERE (month(month) + length(role)) % 3 > 0 AND NOT (role = '5-LOW' AND month > DATE '2000-06-01'))"
PANEL_SQL = f"""facts AS {SPARSE_SQL}, last AS (SELECT max(month) AS m FROM facts),
    grid AS (SELECT role, CAST(g AS DATE) AS month, i AS time_idx FROM (SELECT DISTINCT o_orderpriority AS role FROM orders),
      (SELECT unnest(generate_series(0, 23)) AS i, (SELECT m FROM last) - INTERVAL 23 MONTH + to_months(CAST(unnest(generate_series(0, 23)) AS INTEGER)) AS g)),
    panel AS (SELECT role, month, CAST(time_idx AS INTEGER) AS time_idx, n, total FROM grid LEFT JOIN facts USING (role, month))"""
CARRIED_SQL = f"""{PANEL_SQL}, c AS (SELECT *, max(CASE WHEN n > 0 THEN time_idx END) OVER (PARTITION BY role) AS cut FROM panel),
    o AS (SELECT *, coalesce(time_idx <= cut, false) AS observed FROM c),
    carried AS (SELECT role, month, time_idx, n, observed, coalesce(last_value(CASE WHEN observed THEN coalesce(total, 0) END IGNORE NULLS)
        OVER (PARTITION BY role ORDER BY time_idx ROWS UNBOUNDED PRECEDING), 0) AS total FROM o)"""
DENSE_SQL = f"dense AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY month) AS i, month, n, total FROM {MONTHLY})"


def panel(t: Tables) -> DataFrame:
    m = monthly(t)
    facts = m.where(((F.month("month") + F.length("role")) % 3 > 0) & ~((F.col("role") == "5-LOW") & (F.col("month") > "2000-06-01")))
    return S.dense_panel(facts, m.select("role").distinct(), "role", 24)


def carried(t: Tables) -> DataFrame:
    return S.carried(panel(t), "role", "n", "total")


def dense(t: Tables) -> DataFrame:
    return monthly(t).withColumn("i", F.row_number().over(Window.partitionBy("role").orderBy("month")))


@R.add("w01_dense_panel", f"WITH {PANEL_SQL} SELECT role, month, time_idx, n, total FROM panel")
def w01(t: Tables) -> DataFrame:
    return panel(t).select("role", "month", "time_idx", "n", "total")


@R.add("w02_observed_flags", f"WITH {PANEL_SQL} SELECT role, month, coalesce(n > 0, false) OR coalesce(abs(total) > 0, false) AS seen FROM panel")
def w02(t: Tables) -> DataFrame:
    return panel(t).select("role", "month", S.observed(F.col("n"), F.col("total")).alias("seen"))


@R.add("w03_w04_carried", f"WITH {CARRIED_SQL} SELECT role, month, observed, round(total, 2) AS total FROM carried")
def w04(t: Tables) -> DataFrame:
    return carried(t).select("role", "month", "observed", F.round("total", 2).alias("total"))


@R.add("w05_complete_months", """SELECT CAST(unnest(generate_series(m - INTERVAL 12 MONTH, m - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT date_trunc('month', max(o_orderdate)) AS m FROM orders)""")
def w05(t: Tables) -> DataFrame:
    """The twelve complete months before the newest one."""
    as_of = t("orders").agg(F.trunc(F.max("o_orderdate"), "month").alias("m"))
    return as_of.select(F.explode(F.sequence(F.add_months("m", -12), F.add_months("m", -1), F.expr("interval 1 month"))).alias("month"))


@R.add("w06_supervised_windows", f"""WITH {CARRIED_SQL}, w AS (SELECT role, time_idx AS start, list(total) OVER x AS v, list(observed) OVER x AS o FROM carried
      WINDOW x AS (PARTITION BY role ORDER BY time_idx ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING))
    SELECT role, start, round(list_sum(v[1:6]), 2) AS inputs, round(list_sum(v[7:9]), 2) AS targets FROM w WHERE len(v) = 9 AND o[7] AND o[8] AND o[9]""")
def w06(t: Tables) -> DataFrame:
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 2)
    return S.supervised_windows(carried(t), "role", "total", 6, 3).select("role", "start", total("inputs").alias("inputs"), total("targets").alias("targets"))


@R.add("w08_standardised", f"""WITH {CARRIED_SQL}, w AS (SELECT role, time_idx AS start, list(total) OVER x AS v, list(observed) OVER x AS o FROM carried WINDOW x AS (PARTITION BY role ORDER BY time_idx ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
    f AS (SELECT role, start, v[1:6] AS x, list_transform(v[7:9], lambda y: y - v[6]) AS d FROM w WHERE len(v) = 9 AND o[7] AND o[8] AND o[9]), s AS (SELECT avg(u) AS m, stddev_pop(u) AS sd FROM (SELECT unnest(x) AS u FROM f)), t AS (SELECT avg(u) AS tm, stddev_pop(u) AS ts FROM (SELECT unnest(d) AS u FROM f))
    SELECT role, start, list_transform(x, lambda u: round((u - m) / sd, 5)) AS inputs, list_transform(x, lambda u: 0.0) AS flat, list_transform(d, lambda u: round((u - tm) / ts, 5)) AS targets FROM f, s, t""")
def w08(t: Tables) -> DataFrame:
    """Windows of two features, one without spread."""
    windows = S.supervised_windows(carried(t), "role", "total", 6, 3).withColumn("flat", F.transform("inputs", lambda x: F.lit(7.0)))
    stats = S.standardiser(windows, ["inputs", "flat"], "targets", "inputs")
    found = S.standardised(windows, stats, ["inputs", "flat"], "targets", "inputs")
    near = lambda c: F.transform(c, lambda x: F.round(x, 5)).alias(c)
    return found.select("role", "start", near("inputs"), "flat", near("targets"))


@R.add("w09_robust_trend", f"""WITH {DENSE_SQL}, s AS (SELECT a.role, median((b.n - a.n) / (b.i - a.i)) AS slope FROM dense a JOIN dense b ON a.role = b.role AND a.i < b.i GROUP BY 1),
    k AS (SELECT role, count(*) AS c, greatest(max(n) - min(n), stddev_pop(n), 0.05) AS sc FROM dense GROUP BY 1)
    SELECT role, round(tanh(slope * (c - 1) / sc), 6) AS trend FROM s JOIN k USING (role)""")
def w09(t: Tables) -> DataFrame:
    return S.robust_trend(dense(t), "role", "i", "n").select("role", F.round("trend", 6).alias("trend"))


@R.add("w11_calibrated", """WITH x AS (SELECT n_nationkey AS k, s AS source, CASE s WHEN 'code' THEN 0.02 WHEN 'news' THEN 0.03 ELSE 0.05 END AS c, CASE s WHEN 'code' THEN (n_nationkey - 12) / 300.0 WHEN 'news' THEN (n_nationkey % 5) / 50.0 ELSE -(n_nationkey % 3) / 40.0 END AS v, (n_nationkey + length(s)) % 2 = 0 AS e FROM nation, (SELECT unnest(['code', 'news', 'papers']) AS s)),
    t AS (SELECT k, sum(v) AS raw, sum(CASE WHEN e THEN c ELSE 0 END) / 0.1 AS quality FROM x GROUP BY 1), d AS (SELECT s, CASE WHEN s <= 3 THEN 1.0 WHEN s <= 6 THEN (7 - s) / 4.0 ELSE 0 END AS d FROM (SELECT unnest(generate_series(1, 8)) AS s))
    SELECT k AS n_nationkey, source, CAST(s AS INTEGER) AS step, round(v * CASE WHEN abs(raw) > 0.05 THEN greatest(-0.05, least(0.05, raw)) / raw ELSE 1 END * d, 6) + 0.0 AS contribution, round(greatest(-0.05, least(0.05, raw)) * d, 6) + 0.0 AS adjustment, round(greatest(0, least(1, quality)), 6) AS quality FROM x JOIN t USING (k), d""")
def w11(t: Tables) -> DataFrame:
    k, s = F.col("n_nationkey"), F.col("source")
    rows = t("nation").select("n_nationkey", F.explode(F.array(F.lit("code"), F.lit("news"), F.lit("papers"))).alias("source"))
    value = F.when(s == "code", (k - 12) / 300.0).when(s == "news", k % 5 / 50.0).otherwise(-(k % 3) / 40.0)
    rows = rows.withColumn("c", value).withColumn("e", (k + F.length(s)) % 2 == 0)
    found = S.calibrated(rows, "n_nationkey", "source", "c", "e", {"code": 0.02, "news": 0.03, "papers": 0.05}, 8, 0.05)
    return found.select("n_nationkey", "source", "step", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("contribution", "adjustment", "quality")])


@R.add("w12_signal_strength", f"""WITH {CARRIED_SQL}, e AS (SELECT role, arg_min(total, time_idx) AS a, arg_max(total, time_idx) AS b, stddev_pop(total) AS sd, count(*) AS c FROM carried WHERE observed GROUP BY 1),
    s AS (SELECT role, avg(observed::INT) AS share FROM carried GROUP BY 1)
    SELECT role, round(0.65 * share + 0.35 * CASE WHEN c IS NULL THEN 0 WHEN c = 1 THEN 0.5 ELSE (tanh((b - a) / greatest(abs(a), sd, 1e-6)) + 1) / 2 END, 6) AS strength FROM s LEFT JOIN e USING (role)""")
def w12(t: Tables) -> DataFrame:
    return S.signal_strength(carried(t), "role", "total").select("role", F.round("strength", 6).alias("strength"))


@R.add("w13_step_confidence", """SELECT n_nationkey, CAST(s AS INTEGER) AS step, round(greatest(0.05, least(0.95, 0.15 + 0.70 * exp(-0.035 * (s - 1)) * greatest(0.15, 1 - 2 * least(n_nationkey / 40.0, 0.5)) + 0.15 * 0.4
    + 0.05 * CASE WHEN s <= 3 THEN 1.0 WHEN s <= 6 THEN (7 - s) / 4.0 ELSE 0 END * 0.8)), 4) AS confidence FROM nation, (SELECT unnest(generate_series(1, 8)) AS s)""")
def w13(t: Tables) -> DataFrame:
    rows = t("nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("step"))
    return rows.select("n_nationkey", "step", S.step_confidence(F.col("step"), F.col("n_nationkey") / 40.0, F.lit(0.4), F.lit(0.8)).alias("confidence"))


@R.add("w14_directions", """SELECT event_id, CASE WHEN value / 100 >= 0.58 THEN 'up' WHEN value / 100 <= 0.42 THEN 'down' ELSE 'flat' END AS level,
    CASE WHEN (value - 20) / 100 > 0.03 THEN 'up' WHEN (value - 20) / 100 < -0.03 THEN 'down' ELSE 'flat' END AS change FROM events""")
def w14(t: Tables) -> DataFrame:
    v = F.col("value")
    return t("events").select("event_id", S.direction_by_level(v / 100).alias("level"), S.direction_by_change((v - 20) / 100).alias("change"))


@R.add("w15_forecast_metrics", f"""WITH {DENSE_SQL}, t AS (SELECT max(n) AS top FROM dense), p AS (SELECT (i - 1) % 7 AS step, n / top AS y, lag(n) OVER (PARTITION BY role ORDER BY i) / top AS p FROM dense, t), q AS (SELECT *, CASE WHEN y >= 0.58 THEN 1 WHEN y <= 0.42 THEN -1 ELSE 0 END AS dy, CASE WHEN p >= 0.58 THEN 1 WHEN p <= 0.42 THEN -1 ELSE 0 END AS dp FROM p WHERE p IS NOT NULL)
    SELECT round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(2 * abs(p - y) / (abs(y) + abs(p) + 1e-6)), 6) AS smape, round(avg(abs(p - y)) FILTER (step = 3), 6) AS horizon_3_mae, round(avg((dy = dp)::INT) FILTER (step = 3), 6) AS horizon_3_direction_accuracy,
    round(avg(abs(p - y)) FILTER (step = 6), 6) AS horizon_6_mae, round(avg((dy = dp)::INT) FILTER (step = 6), 6) AS horizon_6_direction_accuracy, CAST(NULL AS DOUBLE) AS horizon_12_mae, CAST(NULL AS DOUBLE) AS horizon_12_direction_accuracy FROM q""")
def w15(t: Tables) -> DataFrame:
    d = dense(t)
    scaled = d.crossJoin(F.broadcast(d.agg(F.max("n").alias("top")))).withColumn("y", F.col("n") / F.col("top"))  # one row
    pairs = scaled.withColumn("p", F.lag("y").over(Window.partitionBy("role").orderBy("i"))).where("p is not null").withColumn("step", (F.col("i") - 1) % 7)
    m = S.forecast_metrics(pairs, "y", "p", "step")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@R.add("w16_milestones", f"""WITH {DENSE_SQL}, e AS (SELECT role, arg_min(n, i) AS a, arg_max(n, i) AS b, max(i) - min(i) AS span FROM dense GROUP BY 1)
    SELECT role, CAST(s AS INTEGER) AS step, round(greatest(0, b + (b - a) / span * s), 6) AS forecast FROM e, (SELECT unnest([3, 6, 12, 24, 36]) AS s)""")
def w16(t: Tables) -> DataFrame:
    f = S.drift_forecast(dense(t), "role", "i", "n", 36).where(F.col("step").isin(*S.MILESTONES))
    return f.select("role", "step", F.round("forecast", 6).alias("forecast"))


SCORED = f"""{DENSE_SQL}, z AS (SELECT role, i, round((n - avg(n) OVER ()) / stddev_pop(n) OVER () * 0.46, 6) AS a, round((total - avg(total) OVER ()) / stddev_pop(total) OVER () * -0.16, 6) AS b FROM dense)"""
WEIGHTS = {"n": 0.46, "total": -0.16}


@R.add("w18_weighted_score", f"WITH {SCORED} SELECT role, i, round(1 / (1 + exp(-(a + b))), 6) AS score FROM z")
def w18(t: Tables) -> DataFrame:
    return S.weighted_score(dense(t), WEIGHTS).select("role", F.col("i").cast("long").alias("i"), "score")


@R.add("w19_score_confidence", """SELECT o_orderkey, round(least(0.98, 0.22 + 0.30 * least(o_orderkey % 5 / 3, 1.0) + CASE WHEN o_orderkey % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0.13 ELSE 0 END
    + CASE WHEN o_totalprice > 100000 THEN 0.10 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.10 ELSE 0 END), 6) AS confidence FROM orders""")
def w19(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    c = S.score_confidence(k % 5, [k % 2 == 0, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, k % 3 == 0])
    return t("orders").select("o_orderkey", F.round(c, 6).alias("confidence"))


@R.add("w20_top_factors", f"""WITH {SCORED} SELECT role, i, CASE WHEN abs(a) > 0.03 AND abs(b) > 0.03 THEN CASE WHEN abs(a) >= abs(b) THEN 'n,total' ELSE 'total,n' END
    WHEN abs(a) > 0.03 THEN 'n' WHEN abs(b) > 0.03 THEN 'total' ELSE '' END AS factors FROM z""")
def w20(t: Tables) -> DataFrame:
    return S.weighted_score(dense(t), WEIGHTS).select("role", F.col("i").cast("long").alias("i"), F.array_join(S.top_factors(F.col("contributions")), ",").alias("factors"))


#: A role's newest 36 months as shares of its largest, with dips in the middle, at the end and at the start; one role is short.
CURVES_SQL = f"""{DENSE_SQL}, mx AS (SELECT role, max(i) AS m, max(n) AS top FROM dense GROUP BY 1),
    fc AS (SELECT role, CAST(i - m + 36 AS INTEGER) AS step, CAST(n AS DOUBLE) / top * CASE WHEN role < '2' AND i - m + 36 BETWEEN 18 AND 22 OR role >= '2' AND role < '3' AND i - m + 36 > 30 OR role >= '3' AND role < '4' AND i - m + 36 IN (1, 2, 9) THEN 0.3 ELSE 1 END AS v,
      0.9 - (i - m + 36) / 100.0 AS confidence, i - m + 36 > 30 OR role > '4' AS ready FROM dense JOIN mx USING (role) WHERE i > m - 37)"""


def smoothed_sql(curves: str) -> str:
    """CTEs up to `smooth` (role, months, s) of a relation (role, months, raw)."""
    return f"""based AS (SELECT *, len(raw) AS n, CASE WHEN list_median(raw[1:12]) < 0.01 THEN list_avg(raw[1:12]) ELSE list_median(raw[1:12]) END AS b FROM {curves}),
    dips AS (SELECT *, list_filter(range(1, n + 1), lambda k: raw[k] < 0.6 * b) AS d FROM based),
    ends AS (SELECT *, d[1] AS a, d[-1] AS z, CASE WHEN d[1] > 1 THEN list_avg(raw[greatest(1, d[1] - 3) : d[1] - 1]) ELSE raw[1] END AS pre FROM dips),
    lines AS (SELECT *, CASE WHEN z < n THEN list_avg(raw[z + 1 : z + 3]) ELSE pre * 0.9 END AS post FROM ends),
    bridged AS (SELECT *, list_transform(range(1, n + 1), lambda k: CASE WHEN k BETWEEN a AND z THEN pre * (1 - (k - a) / (z - a + 1)) + post * ((k - a) / (z - a + 1)) ELSE raw[k] END) AS o FROM lines),
    means AS (SELECT *, list_reduce(list_transform(o, lambda x: [x]), lambda acc, x: list_append(acc, 0.6 * x[1] + 0.4 * acc[-1])) AS e, list_reduce(list_transform(raw, lambda x: [x]), lambda acc, x: list_append(acc, 0.7 * x[1] + 0.3 * acc[-1])) AS plain FROM bridged),
    capped AS (SELECT *, list_reduce(list_transform(e, lambda x: [x]), lambda acc, x: list_append(acc, CASE WHEN acc[-1] > 0.02 THEN least(greatest(x[1], acc[-1] * 0.85), acc[-1] * 1.15) ELSE x[1] END)) AS c FROM means),
    smooth AS (SELECT role, months, CASE WHEN n < 6 THEN raw ELSE list_transform(CASE WHEN len(d) = 0 THEN plain ELSE c END, lambda x: round(least(1.0, greatest(0.0, x)), 6)) END AS s FROM capped)"""


def curves(t: Tables) -> DataFrame:
    d = dense(t)
    top = d.groupBy("role").agg(F.max("i").alias("m"), F.max("n").alias("top"))
    step, role = (F.col("i") - F.col("m") + 36).cast("int"), F.col("role")
    low = ((role < "2") & step.between(18, 22)) | ((role >= "2") & (role < "3") & (step > 30)) | ((role >= "3") & (role < "4") & step.isin(1, 2, 9))
    rows = d.join(top, "role").select("role", step.alias("step"), (F.col("n").cast("double") / F.col("top") * F.when(low, 0.3).otherwise(1.0)).alias("v"), (0.9 - step / 100.0).alias("confidence"), ((step > 30) | (role > "4")).alias("ready"))
    return rows.where("step >= 0")


@R.add("w21_smoothed", f"""WITH {CURVES_SQL}, raws AS (SELECT role, 36 AS months, list(v ORDER BY step) AS raw FROM fc WHERE step > 0 AND (role <> '5-LOW' OR step < 5) GROUP BY 1), {smoothed_sql('raws')}
    SELECT role, CAST(unnest(range(1, len(s) + 1)) AS BIGINT) AS i, unnest(s) AS v FROM smooth""")
def w21(t: Tables) -> DataFrame:
    rows = curves(t).where((F.col("step") > 0) & ((F.col("role") != "5-LOW") | (F.col("step") < 5)))
    lists = rows.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("step", "v"))).alias("l")).select("role", F.col("l.v").alias("l"))
    out = lists.select("role", F.posexplode(S.smoothed("l")).alias("p", "v"))
    return out.select("role", (F.col("p") + 1).cast("long").alias("i"), "v")


@R.add("w22_robust_direction", f"""WITH {DENSE_SQL}, s AS (SELECT role, regr_slope(n / 100.0, i) AS slope, avg(n / 100.0) - arg_max(n / 100.0, i) AS gap FROM dense WHERE i <= 12 GROUP BY 1)
    SELECT role, round(slope, 8) AS slope, CASE WHEN slope > 0.002 THEN 'up' WHEN slope < -0.005 THEN 'down' WHEN slope < -0.003 AND gap < -0.03 THEN 'down' ELSE 'flat' END AS direction FROM s""")
def w22(t: Tables) -> DataFrame:
    x = F.col("n") / 100.0
    s = dense(t).where("i <= 12").groupBy("role").agg(F.regr_slope(x, "i").alias("slope"), (F.avg(x) - F.max_by(x, "i")).alias("gap"))
    return s.select("role", F.round("slope", 8).alias("slope"), S.robust_direction(F.col("slope"), F.col("gap")).alias("direction"))


@R.add("w24_turning_points", f"""WITH {DENSE_SQL}, d AS (SELECT role, i, n, n - lag(n) OVER (PARTITION BY role ORDER BY i) AS diff FROM dense), z AS (SELECT *, (diff - avg(diff) OVER (PARTITION BY role)) / stddev_pop(diff) OVER (PARTITION BY role) AS z FROM d WHERE diff IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY abs(diff) DESC, i) AS rank FROM z WHERE abs(z) >= 1.5)
    SELECT role, i, diff, round(z, 6) AS z, round(diff / nullif(n - diff, 0), 6) AS ratio, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def w24(t: Tables) -> DataFrame:
    p = S.turning_points(dense(t), "role", "i", "n")
    return p.select("role", F.col("i").cast("long").alias("i"), "diff", F.round("z", 6).alias("z"), F.round("ratio", 6).alias("ratio"), "rank")


@R.add("w25_recent_summary", f"""WITH {DENSE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY i DESC) AS k FROM dense)
    SELECT role, arg_min(n, i) AS first, arg_max(n, i) AS last, arg_max(n, i) - arg_min(n, i) AS change, round(regr_slope(n, i), 6) AS slope FROM r WHERE k <= 12 GROUP BY 1""")
def w25(t: Tables) -> DataFrame:
    return S.recent_summary(dense(t), "role", "i", "n").select("role", "first", "last", "change", F.round("slope", 6).alias("slope"))


@R.add("w26_key_factors", f"""WITH {DENSE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY i DESC) AS k FROM dense),
    m AS (SELECT role, 'n' AS metric, arg_max(n, i) - arg_min(n, i) AS change FROM r WHERE k <= 12 GROUP BY 1 UNION ALL SELECT role, 'total', arg_max(total, i) - arg_min(total, i) FROM r WHERE k <= 12 GROUP BY 1)
    SELECT role, metric, CAST(sign(change) AS INTEGER) AS sign FROM m""")
def w26(t: Tables) -> DataFrame:
    long = dense(t).withColumn("n", F.col("n").cast("double")).unpivot(["role", "i"], ["n", "total"], "metric", "value")
    long = long.withColumn("k", F.concat_ws("|", "role", "metric"))
    s = S.recent_summary(long, "k", "i", "value")
    return s.select(F.split_part("k", F.lit("|"), F.lit(1)).alias("role"), F.split_part("k", F.lit("|"), F.lit(2)).alias("metric"), F.signum("change").cast("int").alias("sign"))


@R.add("w27_latest", f"SELECT role, month, n, total FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY month DESC) AS k FROM {MONTHLY}) WHERE k = 1")
def w27(t: Tables) -> DataFrame:
    return S.latest(monthly(t), "role", "month").select("role", "month", "n", "total")


@R.add("w29_row_choice", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F')::INT DESC, abs(month(o_orderdate) - 3), o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def w29(t: Tables) -> DataFrame:
    from harborline.operators.relational import top_per_key

    order = [(F.col("o_orderstatus") == "F").desc(), F.abs(F.month("o_orderdate") - 3), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return top_per_key(t("orders"), ["o_custkey"], order, 1).select("o_custkey", "o_orderkey")
