"""Signals of trends and the evidence for them, over orders by priority and month, and events by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators import evidence as E
from harborline.operators import retrieval as V
from harborline.operators import series as S
from harborline.operators import signals as T
from harborline.plans.registry import Registry, Tables
from harborline.plans.series import CURVES_SQL, DENSE_SQL, SCORED, WEIGHTS, curves, dense, smoothed_sql

R = Registry()

#: News candidates: the events, with themes, sites, titles, quality and affinity made of their columns.
NEWS_SQL = """(SELECT *, CASE WHEN tone > 1 THEN 'positive' WHEN tone < -1 THEN 'negative' ELSE 'neutral' END AS impact FROM (SELECT event_id, event_type AS role, user_id, CAST(ts AS DATE) AS day, value, (value - 20) / 10 AS tone,
    CASE user_id % 3 WHEN 0 THEN 'econ_jobs;' WHEN 1 THEN 'TECH_AI;;' ELSE '' END || CASE event_id % 4 WHEN 0 THEN 'TAX_A' WHEN 1 THEN ' UNGP_B' ELSE 'EDU' || (event_id % 5) END AS themes, 'd' || (user_id % 7) AS domain, 'u' || (event_id % 97) AS url,
    CASE WHEN user_id % 3 = 0 THEN '' ELSE 't' || (event_id % 61) END AS title, (user_id % 5) / 4.0 AS quality, CASE WHEN event_type IN ('view', 'click') THEN 0.2 ELSE (event_id % 10) / 9.0 END AS affinity FROM events))"""
NET_SQL = f"""(SELECT role, count(*) FILTER (contains(upper(themes), 'ECON') AND tone > 0) AS opportunities, count(*) FILTER (contains(upper(themes), 'ECON') AND tone < 0) AS risks FROM {NEWS_SQL} GROUP BY 1)"""


def news(t: Tables) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    mark = lambda m, c: F.concat(F.lit(m), c.cast("string"))
    themes = F.concat(
        F.when(u % 3 == 0, "econ_jobs;").when(u % 3 == 1, "TECH_AI;;").otherwise(""),
        F.when(e % 4 == 0, "TAX_A").when(e % 4 == 1, " UNGP_B").otherwise(mark("EDU", e % 5)),
    )
    tone = (F.col("value") - 20) / 10
    return t("events").select(
        e, F.col("event_type").alias("role"), u, F.to_date("ts").alias("day"), "value", tone.alias("tone"), themes.alias("themes"), mark("d", u % 7).alias("domain"),
        mark("u", e % 97).alias("url"), F.when(u % 3 == 0, "").otherwise(mark("t", e % 61)).alias("title"), (u % 5 / 4.0).alias("quality"),
        F.when(F.col("event_type").isin("view", "click"), 0.2).otherwise(e % 10 / 9.0).alias("affinity"), E.impact_of(tone).alias("impact"),
    )


def aggregates(t: Tables) -> DataFrame:
    return E.evidence_aggregate(news(t), "role", "tone", "themes", "domain", ["ECON"])


@R.add("g12_evidence_aggregate", f"""WITH n AS {NEWS_SQL}, a AS (SELECT role, count(*) AS articles, round(avg(tone), 3) AS mean_tone, round(avg((tone > 0)::INT), 3) AS positive FROM n GROUP BY 1), e AS (SELECT role, trim(unnest(string_split(themes, ';'))) AS theme FROM n),
    c AS (SELECT role, theme, row_number() OVER (PARTITION BY role ORDER BY x DESC, theme) AS k FROM (SELECT role, theme, count(*) AS x FROM e WHERE theme <> '' AND NOT starts_with(theme, 'TAX_') AND NOT starts_with(theme, 'UNGP_') GROUP BY 1, 2)),
    d AS (SELECT role, domain, row_number() OVER (PARTITION BY role ORDER BY x DESC, domain) AS k FROM (SELECT role, domain, count(*) AS x FROM n GROUP BY 1, 2)), tl AS (SELECT role, list(theme ORDER BY k) AS themes FROM c WHERE k <= 6 GROUP BY 1), dl AS (SELECT role, list(domain ORDER BY k) AS domains FROM d WHERE k <= 5 GROUP BY 1)
    SELECT role, articles, mean_tone, positive, opportunities, risks, CASE WHEN opportunities > risks THEN 'positive' WHEN risks > opportunities THEN 'negative' ELSE 'mixed' END AS net, themes, domains FROM a JOIN {NET_SQL} USING (role) JOIN tl USING (role) JOIN dl USING (role)""")
def g12(t: Tables) -> DataFrame:
    return aggregates(t)


@R.add("r03_composite", f"""WITH r AS (SELECT *, (day - min(day) OVER w) / greatest(max(day) OVER w - min(day) OVER w, 1) AS recent, max(value) OVER w AS most FROM {NEWS_SQL} WINDOW w AS (PARTITION BY role))
    SELECT event_id, round(0.25 * value / most + 0.05 * recent + 0.2 * quality, 6) AS rank_score FROM r""")
def r03(t: Tables) -> DataFrame:
    e = V.with_recency(news(t), "role", "day", "recent")
    return V.composite(e, "role", "value", {"recent": 0.05, "quality": 0.2}).select("event_id", F.round("rank_score", 6).alias("rank_score"))


def pick_sql(base: str, group: str, k: int) -> str:
    """Common table expressions that pick from base (group, event_id, impact, want, affinity, quality, sc); the last is `kept`."""
    w = f"PARTITION BY {group}"
    return f"""p AS (SELECT *, bool_or(affinity >= 0.5) OVER ({w}) AS st, CASE want WHEN 'positive' THEN 'negative' WHEN 'negative' THEN 'positive' END AS cw FROM {base}),
    o AS (SELECT *, CASE WHEN st THEN affinity >= 0.5 ELSE quality >= 0.5 END AS inn, coalesce(impact = want, false) AS wa, coalesce(impact = cw, false) AS ag FROM p),
    k AS (SELECT *, row_number() OVER ({w} ORDER BY inn DESC, wa DESC, sc DESC, event_id) AS pl, row_number() OVER ({w} ORDER BY (ag AND (NOT st OR affinity >= 0.5)) DESC, sc DESC, event_id) AS b FROM o),
    l AS (SELECT *, inn AND pl <= {k} AS taken, ag AND (NOT st OR affinity >= 0.5) AND b = 1 AS best FROM k),
    m AS (SELECT *, max(CASE WHEN taken THEN pl END) OVER ({w}) AS la, bool_or(taken AND ag) OVER ({w}) AS held, bool_or(best) OVER ({w}) AS anyb FROM l),
    f AS (SELECT *, NOT held AND anyb AND la IS NOT NULL AS sw FROM m),
    kept AS (SELECT *, CAST(CASE WHEN sw AND best THEN la ELSE pl END AS INTEGER) AS place, NOT st AND quality >= 0.5 AS weak FROM f WHERE CASE WHEN sw THEN (taken AND pl < la) OR best ELSE taken END)"""


@R.add("r05_counter_signal", f"""WITH b AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' END AS want, value AS sc FROM {NEWS_SQL}), {pick_sql("b", "user_id", 4)} SELECT user_id, event_id, place, weak FROM kept""")
def r05(t: Tables) -> DataFrame:
    want = F.when(F.col("user_id") % 3 == 0, "positive").when(F.col("user_id") % 3 == 1, "negative")
    order = [F.col("value").desc(), F.col("event_id")]
    return E.picked_events(news(t).withColumn("want", want), "user_id", "want", "impact", "affinity", "quality", order, 4).select("user_id", "event_id", "place", "weak")


ASKED = [("error", "down"), ("click", "flat"), ("purchase", "up"), ("view", None), ("signup", "stable"), ("ghost", "up")]
BATCH_SQL = f"""a AS (SELECT role, CASE WHEN opportunities > risks THEN 'positive' WHEN risks > opportunities THEN 'negative' ELSE 'mixed' END AS net FROM {NET_SQL}), asked AS (SELECT * FROM (VALUES ('error', 'down'), ('click', 'flat'), ('purchase', 'up'), ('view', NULL), ('signup', 'stable'), ('ghost', 'up')) v(role, d)),
    q AS (SELECT role, net, CASE WHEN coalesce(d IN ('flat', 'stable'), true) AND net = 'positive' THEN 'up' WHEN coalesce(d IN ('flat', 'stable'), true) AND net = 'negative' THEN 'down' ELSE d END AS direction FROM asked LEFT JOIN a USING (role)),
    g AS (SELECT * FROM {NEWS_SQL} WHERE quality > 0), s AS (SELECT *, round(0.25 * value / max(value) OVER w + 0.05 * ((day - min(day) OVER w) / greatest(max(day) OVER w - min(day) OVER w, 1)) + 0.2 * quality, 9) AS sc FROM g WINDOW w AS (PARTITION BY role)),
    u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY role, url ORDER BY sc DESC, event_id) = 1), dd AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY role, title ORDER BY sc DESC, event_id) = 1 OR title = ''),
    base AS (SELECT dd.*, direction, CASE direction WHEN 'up' THEN 'positive' WHEN 'down' THEN 'negative' END AS want FROM dd JOIN q USING (role)), {pick_sql("base", "role", 5)},
    batch AS (SELECT role, direction, place, event_id, weak, 'events' AS source FROM kept UNION ALL SELECT role, direction, n_nationkey + 1, n_nationkey, false, 'precomputed' FROM q, nation WHERE net IS NULL AND n_nationkey < 5)"""


def batch(t: Tables) -> DataFrame:
    n = news(t)
    asked = n.sparkSession.createDataFrame(ASKED, "role string, direction string")

    def ranked(rows: DataFrame) -> DataFrame:
        scored = V.composite(V.with_recency(rows, "role", "day", "recent"), "role", "value", {"recent": 0.05, "quality": 0.2})
        return scored.withColumn("sc", F.round("rank_score", 9))

    stored = t("nation").select(F.lit("ghost").alias("role"), F.col("n_nationkey").cast("long").alias("event_id"), (F.col("n_nationkey") + 1).alias("place"))
    return E.batch_evidence(asked, "role", n, F.col("quality") > 0, aggregates(t), ranked, stored, "event_id", [F.col("sc").desc(), F.col("event_id")])


@R.add("r06_batch_evidence", f"WITH {BATCH_SQL} SELECT * FROM batch")
def r06(t: Tables) -> DataFrame:
    return batch(t)


@R.add("r07_in_range_first", """WITH m AS (SELECT *, o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-01' AS in_range FROM orders), a AS (SELECT *, max(in_range::INT) OVER (PARTITION BY o_custkey) AS x FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM a WHERE in_range OR x = 0) SELECT o_custkey, o_orderkey, in_range, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def r07(t: Tables) -> DataFrame:
    low, high = F.lit("1997-01-01").cast("timestamp"), F.lit("1997-03-01").cast("timestamp")
    top = V.in_range_first(t("orders"), "o_custkey", "o_orderdate", low, high, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3)
    return top.select("o_custkey", "o_orderkey", "in_range", "rank")


CONCLUSIONS = [("error", "down", "R1"), ("click", "flat", "R2"), ("purchase", "up", "R3"), ("view", "stable", "R2"), ("signup", "up", "R9")]
MAJOR_SQL = """c AS (SELECT * FROM (VALUES ('error', 'down', 'R1'), ('click', 'flat', 'R2'), ('purchase', 'up', 'R3'), ('view', 'flat', 'R2'), ('signup', 'up', 'R9')) v(role, direction, category)), mp AS (SELECT * FROM (VALUES ('error', 'down', 'NATION_3', 1), ('error', 'down', 'NOPE', 2), ('signup', 'up', 'NOPE', 1)) v(role, direction, event, place)),
    cat AS (SELECT n_name AS event, n_nationkey * 7 % 11 AS importance, unnest(['R' || n_regionkey, 'R' || ((n_regionkey + 1) % 5)]) AS category, CASE n_nationkey % 3 WHEN 0 THEN ['up'] WHEN 1 THEN ['flat', 'down'] ELSE ['up', 'flat'] END AS fits FROM nation),
    best AS (SELECT role, direction, event, row_number() OVER (PARTITION BY role, direction ORDER BY importance DESC, event) AS place FROM c JOIN cat ON cat.category = c.category AND list_contains(fits, direction) WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.role = c.role AND mp.direction = c.direction)),
    major AS (SELECT role, direction, CAST(place AS INTEGER) AS place, event FROM best WHERE place <= 5 UNION ALL SELECT role, direction, place, event FROM mp WHERE event IN (SELECT n_name FROM nation))"""


@R.add("r08_assembled", f"""WITH {BATCH_SQL}, {MAJOR_SQL} SELECT role, category, (SELECT list(event_id ORDER BY place) FROM batch WHERE batch.role = c.role) AS events, (SELECT list(event ORDER BY place) FROM major WHERE major.role = c.role) AS majors FROM c""")
def r08(t: Tables) -> DataFrame:
    """Conclusions with their evidence and the major events named for them, or of their category."""
    spark = t("nation").sparkSession
    said = spark.createDataFrame(CONCLUSIONS, "role string, direction string, category string")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    fits = F.when(k % 3 == 0, F.array(F.lit("up"))).when(k % 3 == 1, F.array(F.lit("flat"), F.lit("down"))).otherwise(F.array(F.lit("up"), F.lit("flat")))
    catalog = t("nation").select(F.col("n_name").alias("event"), F.array(F.concat(F.lit("R"), r), F.concat(F.lit("R"), (r + 1) % 5)).alias("categories"), fits.alias("fits"), (k * 7 % 11).alias("importance"))
    mapping = spark.createDataFrame([("error", "down", "NATION_3", 1), ("error", "down", "NOPE", 2), ("signup", "up", "NOPE", 1)], "role string, direction string, event string, place int")
    majors = E.major_events(said, "role", "direction", "category", catalog, mapping)
    return E.assembled(said, ["role"], {"events": (batch(t), "event_id"), "majors": (majors, "event")}).select("role", "category", "events", "majors")


@R.add("r10_cited_context", """WITH e AS (SELECT o_custkey, 'E' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS cite, CAST(o_orderkey AS VARCHAR) AS value FROM orders), m AS (SELECT o_custkey, 'M' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS cite, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'F'),
    j AS (SELECT o_custkey, 'J' || row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS cite, CAST(l_partkey AS VARCHAR) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT * FROM e WHERE substr(cite, 2)::INT <= 5 UNION ALL SELECT * FROM m WHERE substr(cite, 2)::INT <= 2 UNION ALL SELECT * FROM j WHERE substr(cite, 2)::INT <= 3""")
def r10(t: Tables) -> DataFrame:
    o = t("orders")
    posts = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    c = F.col
    return E.cited(
        {
            "E": (o, "o_orderkey", [c("o_totalprice").desc(), c("o_orderkey")], 5),
            "M": (o.where("o_orderstatus = 'F'"), "o_orderpriority", [c("o_orderdate"), c("o_orderkey")], 2),
            "J": (posts, "l_partkey", [c("l_extendedprice").desc(), c("l_orderkey"), c("l_linenumber"), c("l_partkey")], 3),
        },
        "o_custkey",
    )


@R.add("r22_risk_notes", """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END AS d, CASE o_orderkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed' END AS net, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 40 END AS n FROM orders)
    SELECT o_orderkey, list_filter([CASE WHEN (d = 'up' AND net = 'negative') OR (d = 'down' AND net = 'positive') THEN 'against_aggregate' END, CASE WHEN n < 20 THEN 'few_articles' END, CASE WHEN o_orderkey % 5 % 2 = 1 THEN 'weak_events' END, CASE WHEN o_orderkey % 5 = 0 THEN 'no_event' END], lambda x: x IS NOT NULL) AS notes FROM o""")
def r22(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    direction = F.when(k % 3 == 0, "up").when(k % 3 == 1, "down").otherwise("flat")
    net = F.when(k % 4 == 0, "positive").when(k % 4 == 1, "negative").when(k % 4 == 2, "mixed")
    events = F.when(k % 5 > 0, k % 5)
    return t("orders").select("o_orderkey", E.risk_notes(direction, net, F.when(k % 4 < 3, k % 40), events, events % 2).alias("notes"))


@R.add("w07_temporal_split", f"""WITH {DENSE_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY i, role) AS k, count(*) OVER () AS c FROM dense WHERE month < DATE '1996-06-01')
    SELECT 'long' AS kind, role, i, CASE WHEN i >= 36 THEN 'validation' ELSE 'train' END AS part FROM dense UNION ALL SELECT 'short', role, i, CASE WHEN k > c - greatest(1, c // 5) THEN 'validation' ELSE 'train' END FROM s""")
def w07(t: Tables) -> DataFrame:
    """The whole series, and one so short that no window starts late enough."""
    d = dense(t)
    both = [("long", d), ("short", d.where("month < '1996-06-01'"))]
    parts = [T.temporal_split(x, "role", "i", 36).select(F.lit(k).alias("kind"), "role", F.col("i").cast("long").alias("i"), "part") for k, x in both]
    return parts[0].unionByName(parts[1])


ORIGIN = 76
SIGNAL_SQL = f"""{DENSE_SQL}, fl AS (SELECT *, i % 2 = 0 AS news, i % 5 = 0 AND (role NOT LIKE '2%' OR i <= 60) AS code, CASE WHEN role LIKE '3%' THEN i = 30 WHEN role LIKE '4%' THEN false ELSE i >= 70 END AS papers FROM dense),
    gates AS (SELECT role, source, count(*) FILTER (f) AS months, {ORIGIN} - max(i) FILTER (f) AS age FROM (SELECT role, i, unnest(['news', 'code', 'papers']) AS source, unnest([news, code, papers]) AS f FROM fl) GROUP BY ALL),
    long AS (SELECT role, 'news' AS source, i, unnest([1, 2, 3, 4]) AS j, unnest([1, 1, -1, 1]) AS w, unnest([n, total, total / n, CASE WHEN role LIKE '1%' THEN n ELSE 0 END]) AS v FROM fl WHERE news UNION ALL SELECT role, 'code', i, unnest([1, 2]), unnest([0.75, 0.25]), unnest([ln(1 + n), ln(1 + total)]) FROM fl WHERE code
      UNION ALL SELECT role, 'papers', i, 1, 1, n FROM fl WHERE papers),
    sl AS (SELECT a.role, a.source, a.j, median((b.v - a.v) / (b.i - a.i)) AS slope FROM long a JOIN long b ON a.role = b.role AND a.source = b.source AND a.j = b.j AND a.i < b.i GROUP BY ALL),
    sc AS (SELECT role, source, j, any_value(w) AS w, count(*) AS c, sum(abs(v)) AS mass, greatest(max(v) - min(v), stddev_pop(v), 0.05) AS scale FROM long GROUP BY ALL),
    tr AS (SELECT role, source, sum(w * coalesce(tanh(slope * (c - 1) / scale), 0)) / sum(abs(w)) AS s FROM sc LEFT JOIN sl USING (role, source, j) WHERE NOT (source = 'news' AND j = 4 AND mass = 0) GROUP BY ALL),
    signals AS (SELECT role, source, months, age, ok AS eligible, CASE WHEN ok THEN round(s, 6) END AS signal, CASE WHEN ok THEN round(round(s, 6) * CASE source WHEN 'news' THEN 0.03 WHEN 'code' THEN 0.015 ELSE 0.01 END, 6) ELSE 0.0 END AS contribution
      FROM (SELECT *, months >= 2 AND coalesce(age <= 6, false) AS ok FROM gates LEFT JOIN tr USING (role, source)))"""
SOURCES = {
    "news": ("news", 0.03, {"n": (1.0, False, False), "total": (1.0, False, False), "pay": (-1.0, False, False), "extra": (1.0, False, True)}),
    "code": ("code", 0.015, {"n": (0.75, True, False), "total": (0.25, True, False)}),
    "papers": ("papers", 0.01, {"n": (1.0, False, False)}),
}


def signals(t: Tables) -> DataFrame:
    """Three sources of different months: one has too few, one is too old for some roles."""
    i, first = F.col("i"), F.substring("role", 1, 1)
    d = dense(t).withColumn("pay", F.col("total") / F.col("n")).withColumn("extra", F.when(first == "1", F.col("n")).otherwise(0))
    papers = F.when(first == "3", i == 30).when(first == "4", False).otherwise(i >= 70)
    d = d.withColumn("news", i % 2 == 0).withColumn("code", (i % 5 == 0) & ((first != "2") | (i <= 60))).withColumn("papers", papers)
    return T.source_signals(d, "role", "i", F.lit(ORIGIN), SOURCES)


@R.add("w10_source_signal", f"WITH {SIGNAL_SQL} SELECT * FROM signals")
def w10(t: Tables) -> DataFrame:
    s = signals(t)
    return s.select("role", "source", F.col("months").cast("long").alias("months"), F.col("age").cast("long").alias("age"), "eligible", "signal", "contribution")


@R.add("w31_factor_sentences", f"""WITH {SIGNAL_SQL}, x AS (SELECT role, CASE source WHEN 'papers' THEN 0 WHEN 'news' THEN 1 ELSE 2 END AS p, CASE source WHEN 'papers' THEN 'Research' WHEN 'news' THEN 'News' ELSE 'Code' END || ': ' || CASE WHEN contribution > 0 THEN 'adds' WHEN contribution < 0 THEN 'takes' ELSE 'neutral' END
    || printf(' %.4f', CAST(contribution AS DOUBLE)) || CASE WHEN signal IS NULL THEN '' ELSE printf(', signal %.3f', CAST(signal AS DOUBLE)) END AS s FROM signals WHERE months > 0 OR contribution <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY p) AS k FROM x) SELECT role, list(s ORDER BY p) AS factors FROM r WHERE k <= 2 GROUP BY 1""")
def w31(t: Tables) -> DataFrame:
    return T.factor_sentences(signals(t), "role", {"papers": "Research", "news": "News", "code": "Code"}, 2)


SUMMARY_SQL = f"""{CURVES_SQL}, mo AS (SELECT unnest([2, 12, 24, 36]) AS months), raws AS (SELECT role, months, list(v ORDER BY step) AS raw FROM fc, mo WHERE months > 12 AND step BETWEEN 1 AND months GROUP BY 1, 2),
    {smoothed_sql('raws')}, rdy AS (SELECT role, months, bool_and(ready) AS ready FROM fc, mo WHERE step BETWEEN 1 AND months GROUP BY 1, 2),
    lv AS (SELECT role, step, months, confidence, v, CASE WHEN v >= 0.58 THEN 'up' WHEN v <= 0.42 THEN 'down' ELSE 'flat' END AS direction FROM fc JOIN mo ON step = months),
    short AS (SELECT role, months, v AS level, direction, confidence FROM lv WHERE months <= 12),
    used AS (SELECT role, months, ready, CASE WHEN ready THEN raw ELSE s END AS s, now FROM smooth JOIN raws USING (role, months) JOIN rdy USING (role, months) JOIN (SELECT role, v AS now FROM fc WHERE step = 0) USING (role)),
    sl AS (SELECT role, months, regr_slope(v, k) AS slope, avg(v) AS mean FROM (SELECT role, months, unnest(s[1:12]) AS v, unnest(range(12)) AS k FROM used) GROUP BY 1, 2),
    far AS (SELECT role, months, round(list_avg(s[-6:]), 6) AS level, CASE WHEN ready THEN direction WHEN slope > 0.002 THEN 'up' WHEN slope < -0.005 THEN 'down' WHEN slope < -0.003 AND mean - now < -0.03 THEN 'down' ELSE 'flat' END AS direction, confidence FROM used JOIN sl USING (role, months) JOIN lv USING (role, months))"""


def forecasts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The curves as if they were forecast from the month before them."""
    rows = curves(t)
    return rows.where("step > 0"), rows.where("step = 0").select("role", F.col("v").alias("current"))


@R.add("w23_forecast_summary", f"WITH {SUMMARY_SQL} SELECT role, months, round(level, 6) AS level, direction, round(confidence, 6) AS confidence FROM (FROM short UNION ALL FROM far)")
def w23(t: Tables) -> DataFrame:
    f, now = forecasts(t)
    out = None
    for months in (2, 12, 24, 36):
        s = T.forecast_summary(f, "role", "step", "v", "confidence", now, months, ready="ready").select("role", F.lit(months).alias("months"), F.round("level", 6).alias("level"), "direction", F.round("confidence", 6).alias("confidence"))
        out = s if out is None else out.unionByName(s)
    return out


@R.add("w32_batch_signal", f"""WITH {SUMMARY_SQL}, z AS (SELECT role, i, 1 / (1 + exp(-(round((n - avg(n) OVER ()) / stddev_pop(n) OVER () * 0.46, 6) + round((total - avg(total) OVER ()) / stddev_pop(total) OVER () * -0.16, 6)))) AS score FROM dense), la AS (SELECT role, round(arg_max(score, i), 6) AS level FROM z GROUP BY 1)
    SELECT role, round(level, 6) AS level, direction, round(confidence, 6) AS confidence, 'forecast' AS source FROM far WHERE months = 24 AND role <> '5-LOW' UNION ALL SELECT role, level, CASE WHEN level >= 0.58 THEN 'up' WHEN level <= 0.42 THEN 'down' ELSE 'flat' END, 0.5, 'baseline' FROM la WHERE role = '5-LOW'""")
def w32(t: Tables) -> DataFrame:
    """All roles: one has no forecast, one has nothing and is left out."""
    f, now = forecasts(t)
    summary = T.forecast_summary(f.where("role <> '5-LOW'"), "role", "step", "v", "confidence", now, 24, ready="ready")
    base = S.latest(S.weighted_score(dense(t), WEIGHTS).select("role", "i", "score"), "role", "i")
    base = base.select("role", F.col("score").alias("level"), S.direction_by_level(F.col("score")).alias("direction"), F.lit(0.5).alias("confidence"))
    roles = t("orders").select(F.col("o_orderpriority").alias("role")).unionByName(t("region").select(F.col("r_name").alias("role")))
    out = T.batch_signals(roles, "role", summary, base)
    return out.select("role", F.round("level", 6).alias("level"), "direction", F.round("confidence", 6).alias("confidence"), "source")


@R.add("w28_comparison", f"""WITH {SCORED}, l AS (SELECT role, arg_max(1 / (1 + exp(-(a + b))), i) AS score FROM z GROUP BY 1), f AS (SELECT o_orderpriority AS role, avg((o_orderstatus = 'F')::INT) AS fit, least(0.98, 0.22 + 0.3 * least(count(DISTINCT o_orderstatus) / 3.0, 1)) AS confidence FROM orders GROUP BY 1)
    SELECT role, round(0.58 * fit + 0.28 * round(score, 6) + 0.14 * confidence, 6) AS score FROM l JOIN f USING (role)""")
def w28(t: Tables) -> DataFrame:
    s = S.latest(S.weighted_score(dense(t), WEIGHTS).select("role", "i", "score"), "role", "i").withColumnRenamed("score", "index")
    known = F.count_distinct("o_orderstatus")
    f = t("orders").groupBy(F.col("o_orderpriority").alias("role")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("fit"), known.alias("known"))
    rows = s.join(f, "role").withColumn("confidence", S.score_confidence(F.col("known"), []))
    return T.comparison(rows, F.col("fit"), F.col("index"), F.col("confidence")).select("role", "score")


@R.add("w30_metric_evidence", f"""WITH {DENSE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY i DESC) AS k FROM dense), h AS (SELECT * FROM r WHERE k <= 24), l AS (SELECT role, list(strftime(month, '%Y-%m-%d') ORDER BY i) AS months, list(CAST(n AS DOUBLE) ORDER BY i) AS n_history, list(round(total, 6) ORDER BY i) AS total_history FROM h GROUP BY 1),
    o AS (SELECT role, strftime(min(month), '%Y-%m-%d') AS observed_from, strftime(max(month), '%Y-%m-%d') AS observed_to FROM dense WHERE i % 7 > 0 GROUP BY 1), y AS (SELECT role, CAST(arg_max(n, i) - arg_min(n, i) AS DOUBLE) AS change, round(regr_slope(n, i), 6) AS slope, ['n ' || CAST(sign(arg_max(n, i) - arg_min(n, i)) AS INTEGER), 'total ' || CAST(sign(arg_max(total, i) - arg_min(total, i)) AS INTEGER)] AS factors FROM r WHERE k <= 12 GROUP BY 1),
    d AS (SELECT role, i, n - lag(n) OVER (PARTITION BY role ORDER BY i) AS diff FROM h), z AS (SELECT *, (diff - avg(diff) OVER (PARTITION BY role)) / nullif(stddev_pop(diff) OVER (PARTITION BY role), 0) AS z FROM d WHERE diff IS NOT NULL), tp AS (SELECT role, list(i ORDER BY k)[1:5] AS turning_points FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY abs(diff) DESC, i) AS k FROM z WHERE abs(z) >= 1.5) GROUP BY 1),
    e AS (SELECT role, CASE WHEN role < '3' THEN 0.25 ELSE CAST(arg_max(n, i) AS DOUBLE) END AS level FROM dense GROUP BY 1)
    SELECT role, months, n_history, total_history, observed_from, observed_to, change, slope, factors, turning_points, level, CASE WHEN level >= 0.58 THEN 'up' WHEN level <= 0.42 THEN 'down' ELSE 'flat' END AS direction FROM l JOIN o USING (role) JOIN y USING (role) LEFT JOIN tp USING (role) JOIN e USING (role)""")
def w30(t: Tables) -> DataFrame:
    d = dense(t).withColumn("seen", F.col("i") % 7 > 0)
    said = d.where("role < '3'").select("role").distinct().withColumn("predicted", F.lit(0.25))
    e = T.metric_evidence(d, "role", "i", "month", "seen", ["n", "total"], "n", said, 24)
    factors = F.transform("factors", lambda x: F.concat_ws(" ", x["metric"], x["sign"].cast("string")))
    return e.select(
        "role", "months", "n_history", "total_history", "observed_from", "observed_to", "recent.change", "recent.slope", factors.alias("factors"),
        F.transform("turning_points", lambda x: x.cast("long")).alias("turning_points"), "level", "direction",
    )
