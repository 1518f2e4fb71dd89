"""Grouped features over orders, line items, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import normalise as N
from harborline.operators import aggregates as A
from harborline.operators import relational as O
from harborline.operators import taxonomy as Y
from harborline.plans.registry import Registry, Tables

R = Registry()

POSTS_SQL = """(SELECT p_type AS role, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS years, l_linenumber % 9 AS hits,
    CASE l_linenumber % 4 WHEN 0 THEN 'a BACHELOR''s degree' WHEN 1 THEN 'Master or bachelor' WHEN 2 THEN NULL ELSE 'none' END AS education FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FEATURES_SQL = f"""(SELECT role, month, count(*) AS job_post_count, count(DISTINCT l_suppkey) AS unique_company_count, round(avg(l_extendedprice) + 1e-8, 6) AS avg_salary,
    round(median(l_extendedprice) + 1e-8, 6) AS median_salary, round(avg((l_returnflag = 'R')::INT), 6) AS remote_share, round(avg(contains(lower(coalesce(education, '')), 'bachelor')::INT), 6) AS bachelor_share, round(avg(contains(lower(coalesce(education, '')), 'master')::INT), 6) AS master_share,
    round(avg(years) + 1e-8, 6) AS avg_years, round(avg(hits / 10.0) + 1e-8, 6) AS hit_rate, count(DISTINCT l_returnflag) AS source_count FROM {POSTS_SQL} WHERE month < DATE '2001-08-01' GROUP BY ALL)"""


def posts(t: Tables) -> DataFrame:
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_linenumber")
    degree = F.when(k % 4 == 0, "a BACHELOR's degree").when(k % 4 == 1, "Master or bachelor").when(k % 4 == 3, "none")
    return rows.select(
        F.col("p_type").alias("role"), F.trunc("l_shipdate", "month").alias("month"), "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
        F.when(k % 3 > 0, F.col("l_quantity")).alias("years"), (k % 9).alias("hits"), degree.alias("education"),
    )


def features(t: Tables) -> DataFrame:
    as_of = F.lit("2001-08-15").cast("date")
    return A.posting_features(posts(t), ["role", "month"], "l_suppkey", "l_extendedprice", F.col("l_returnflag") == "R", "education", "years", F.col("hits"), "l_returnflag", as_of, "month", 9, 9)


@R.add("g01_posting_features", f"SELECT * FROM {FEATURES_SQL}")
def g01(t: Tables) -> DataFrame:
    up = {c: F.round(F.col(c) + 1e-8, 6) for c in ("avg_salary", "median_salary", "avg_years", "hit_rate")}  # ties at the seventh place go up
    return features(t).withColumns(up)


INDEX_SQL = f"""idx AS (SELECT role, month, job_post_count, avg_salary, 1 / (1 + exp(-(0.5 * (job_post_count - avg(job_post_count) OVER ()) / stddev_pop(job_post_count) OVER ()
    + 0.2 * (unique_company_count - avg(unique_company_count) OVER ()) / stddev_pop(unique_company_count) OVER () + 0.3 * (remote_share - avg(remote_share) OVER ()) / stddev_pop(remote_share) OVER ()))) AS score FROM {FEATURES_SQL})"""
INDEX = {"job_post_count": 0.5, "unique_company_count": 0.2, "remote_share": 0.3}


@R.add("g02_source_index", f"WITH {INDEX_SQL} SELECT role, month, round(score, 6) AS score FROM idx")
def g02(t: Tables) -> DataFrame:
    return A.weighted_index(features(t), INDEX, "score").select("role", "month", "score")


@R.add("g03_blended_index", """SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 0.5 WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5) / 4.0 WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 3) / 2.0
    ELSE 0.6 * (o_orderkey % 3) / 2.0 + 0.4 * (o_orderkey % 5) / 4.0 END, 6) AS score FROM orders""")
def g03(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", F.round(A.blended([(k % 3 / 2.0, 0.6), (k % 5 / 4.0, 0.4)]), 6).alias("score"))


NEWS_SQL = "(SELECT event_type AS role, CAST(ts AS DATE) AS day, 1.0 / (1 + user_id % 4) AS w, value - 20 AS tone, CASE user_id % 9 WHEN 8 THEN ' ' WHEN 7 THEN NULL ELSE ' D' || (user_id % 7) END AS domain, event_id % 4 / 4.0 AS risk, user_id % 2 / 2.0 AS opportunity FROM events)"


def news(t: Tables) -> DataFrame:
    u = F.col("user_id")
    domain = F.when(u % 9 == 8, " ").when(u % 9 < 7, F.concat(F.lit(" D"), u % 7))
    return t("events").select(
        F.col("event_type").alias("role"), F.to_date("ts").alias("day"), (1.0 / (1 + u % 4)).alias("w"), (F.col("value") - 20).alias("tone"), domain.alias("domain"),
        (F.col("event_id") % 4 / 4.0).alias("risk"), (u % 2 / 2.0).alias("opportunity"),
    )


def news_sql(weight: str, least: str) -> str:
    """Features of the news with each article's weight."""
    return f"""(SELECT role, day, domains, round(n, 6) AS articles, round(s / n, 6) AS tone, round(p / n, 6) AS positive, round(m / n, 6) AS negative, round(p / n - m / n, 6) AS net, round(greatest(-1, least(1, s / n / 10 + p / n - m / n)), 6) AS sentiment, round(r / n, 6) AS risk, round(o / n, 6) AS opportunity FROM
      (SELECT role, day, greatest(sum({weight}), {least}) AS n, sum({weight} * tone) AS s, sum(CASE WHEN tone > 0 THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN tone < 0 THEN {weight} ELSE 0 END) AS m, sum({weight} * risk) AS r, sum({weight} * opportunity) AS o, count(DISTINCT nullif(lower(trim(domain)), '')) AS domains FROM {NEWS_SQL} GROUP BY ALL))"""


@R.add("g05_weighted_tone", f"SELECT * FROM {news_sql('w', '1.0')}")
def g05(t: Tables) -> DataFrame:
    return A.news_features(news(t), ["role", "day"], "tone", "domain", "risk", "opportunity", "w")


@R.add("g06_unweighted_tone", f"SELECT * REPLACE (CAST(articles AS BIGINT) AS articles) FROM {news_sql('1', '1')}")
def g06(t: Tables) -> DataFrame:
    return A.news_features(news(t), ["role", "day"], "tone", "domain", "risk", "opportunity")


@R.add("g07_impact", f"""WITH d AS (SELECT role, day, count(*) AS n, avg(tone) AS tone, avg(opportunity) AS o, avg(risk) AS r FROM {NEWS_SQL} WHERE domain = ' D1' AND day(day) % 3 > 0 GROUP BY ALL), i AS (SELECT f.role, f.day, coalesce(n, 0) AS doc_articles, coalesce(d.tone, 0) AS doc_tone, round(0.5 * sentiment + 0.3 * (opportunity + coalesce(o, 0)) / 2 - 0.2 * (risk + coalesce(r, 0)) / 2, 6) AS impact
      FROM (SELECT * REPLACE (CASE WHEN day(day) % 2 = 0 THEN -sentiment / 9 ELSE sentiment END AS sentiment) FROM {news_sql('w', '1.0')}) f LEFT JOIN d USING (role, day))
    SELECT role, day, doc_articles, round(doc_tone, 6) AS doc_tone, impact, CASE WHEN impact > 0.08 THEN 'positive' WHEN impact < -0.08 THEN 'negative' ELSE 'neutral' END AS direction FROM i""")
def g07(t: Tables) -> DataFrame:
    """Some days have no documents; on even days the tone is turned, so that all three directions are met."""
    features = A.news_features(news(t), ["role", "day"], "tone", "domain", "risk", "opportunity", "w")
    features = features.withColumn("sentiment", F.when(F.day("day") % 2 == 0, -F.col("sentiment") / 9).otherwise(F.col("sentiment")))
    docs = news(t).where((F.col("domain") == " D1") & (F.day("day") % 3 > 0))
    found = A.impact(features, docs, ["role", "day"], "tone", "risk", "opportunity")
    return found.select("role", "day", "doc_articles", F.round("doc_tone", 6).alias("doc_tone"), "impact", "direction")


@R.add("g08_keyword_max", "SELECT event_type, user_id % 10 AS k, max(value) AS value, max(event_id) AS newest FROM events GROUP BY ALL")
def g08(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type", (F.col("user_id") % 10).alias("k")).agg(F.max("value").alias("value"), F.max("event_id").alias("newest"))


@R.add("g09_weighted_average", """SELECT event_type, round(CASE WHEN event_type = 'view' THEN avg(CASE WHEN event_id % 3 > 0 THEN value END) ELSE sum(CASE WHEN event_id % 3 > 0 THEN value * (user_id % 5) END) / sum(CASE WHEN event_id % 3 > 0 THEN user_id % 5 END) END, 6) AS value FROM events GROUP BY 1""")
def g09(t: Tables) -> DataFrame:
    v = F.when(F.col("event_id") % 3 > 0, F.col("value"))
    w = F.when(F.col("event_type") == "view", 0.0).otherwise((F.col("user_id") % 5).cast("double"))
    rows = t("events").select("event_type", v.alias("value"), w.alias("w"))
    return A.weighted_average(rows, ["event_type"], "value", "w").select("event_type", F.round("value", 6).alias("value"))


@R.add("g11_available_sources", "SELECT o_orderkey, (o_orderkey % 2 > 0)::INT + (o_orderkey % 3 > 0)::INT + (o_orderstatus = 'F')::INT AS available FROM orders")
def g11(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 2 > 0).cast("int") + (k % 3 > 0).cast("int") + (F.col("o_orderstatus") == "F").cast("int")
    return t("orders").select("o_orderkey", n.alias("available"))


@R.add("g13_mode_any", """WITH c AS (SELECT p_name, p_type, count(*) AS n, bool_or(p_size > 48) AS h FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_type) AS k, bool_or(h) OVER (PARTITION BY p_name) AS hot FROM c)
    SELECT p_name, p_type, hot FROM r WHERE k = 1""")
def g13(t: Tables) -> DataFrame:
    return A.mode_and_any(t("part").withColumn("hot", F.col("p_size") > 48), "p_name", "p_type", "hot")


@R.add("g14_extraction_stats", """WITH d AS (SELECT source, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents) SELECT source, count(*) AS total, count(*) FILTER (n > 0) AS with_skills, CAST(sum(n) AS BIGINT) AS mentions, round(avg((n > 0)::INT), 4) AS coverage, round(avg(n), 2) AS average FROM d GROUP BY 1""")
def g14(t: Tables) -> DataFrame:
    return A.extraction_stats(t("documents").withColumn("s", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))), "source", "s")


@R.add("g14_top_skills", "SELECT s, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS s FROM documents) GROUP BY 1 ORDER BY n DESC, s LIMIT 100")
def g14_skills(t: Tables) -> DataFrame:
    return A.most_frequent(t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("s")), ["s"], 100)


@R.add("g14_top_keywords", "SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL ORDER BY n DESC, source, lang LIMIT 50")
def g14_keywords(t: Tables) -> DataFrame:
    return A.most_frequent(t("documents"), ["source", "lang"], 50)


@R.add("g15_unmatched_terms", """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9+#][a-z0-9+#.]*(?: [a-z0-9+#][a-z0-9+#.]*){0,2}')) AS term FROM documents), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), c AS (SELECT term, count(*) AS n FROM w WHERE length(term) >= 3 AND term <> 'idiot' AND NOT regexp_matches(term, '^[0-9. ]+$') GROUP BY 1)
    SELECT term, n FROM c WHERE term NOT IN (SELECT term FROM v) ORDER BY n DESC, term LIMIT 100""")
def g15(t: Tables) -> DataFrame:
    known = t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    return Y.unmatched_ngrams(t("documents"), "text", known, "term", ["idiot"])


@R.add("g16_counts_by_sets", """SELECT 'o_orderstatus' AS by, o_orderstatus AS key, count(*) AS total, count(*) FILTER (o_totalprice > 200000) AS kept FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), count(*) FILTER (o_totalprice > 200000) FROM orders GROUP BY 2 UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*), count(*) FILTER (o_totalprice > 200000) FROM orders GROUP BY 2""")
def g16(t: Tables) -> DataFrame:
    return A.counts_by_sets(t("orders").withColumn("year", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "year"], {"kept": F.col("o_totalprice") > 200000})


@R.add("g17_cluster_profile", """WITH s AS (SELECT p_type, count(*) AS size, min(p_partkey) AS first_id FROM part GROUP BY 1), m AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2), mm AS (SELECT p_type, list(p_brand || '=' || n ORDER BY p_brand) AS source_mix FROM m GROUP BY 1),
    w AS (SELECT p_type, unnest(string_split(p_name, ' ')) AS v FROM part), wc AS (SELECT p_type, v, count(*) AS n FROM w GROUP BY 1, 2), wr AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, v) AS k FROM wc), sk AS (SELECT p_type, list(v ORDER BY k) AS skills FROM wr WHERE k <= 5 GROUP BY 1), sf AS (SELECT p_type, list(v || '=' || printf('%.4f', CAST(round(n / size, 4) AS DOUBLE)) ORDER BY v) AS skill_freq FROM wc JOIN s USING (p_type) GROUP BY 1),
    tc AS (SELECT p_type, p_name AS v, count(*) AS n FROM part GROUP BY 1, 2), tr AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, v) AS k FROM tc), ti AS (SELECT p_type, list(v ORDER BY k) AS titles FROM tr WHERE k <= 5 GROUP BY 1),
    kc AS (SELECT p_type, split_part(p_name, ' ', 2) AS v, count(*) AS n FROM part GROUP BY 1, 2), kr AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, v) AS k FROM kc), kw AS (SELECT p_type, list(v ORDER BY k) AS keywords FROM kr WHERE k <= 5 GROUP BY 1)
    SELECT p_type, size, first_id, source_mix, titles, skills, keywords, skill_freq FROM s JOIN mm USING (p_type) JOIN ti USING (p_type) JOIN sk USING (p_type) JOIN kw USING (p_type) JOIN sf USING (p_type)""")
def g17(t: Tables) -> DataFrame:
    rows = t("part").select("p_type", "p_partkey", "p_brand", "p_name", F.split("p_name", " ").alias("skills"), F.array(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("keywords"))
    p = Y.cluster_profiles(rows, "p_type", "p_partkey", "p_brand", "p_name", "skills", "keywords")
    flat = lambda c, f: F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), f(e["value"])))
    mix, freq = flat("source_mix", lambda v: v.cast("string")), flat("skill_freq", lambda v: F.format_string("%.4f", v))
    return p.select("p_type", "size", "first_id", mix.alias("source_mix"), "titles", "skills", "keywords", freq.alias("skill_freq"))


@R.add("g18_merged_clusters", """WITH p AS (SELECT p_size % 4 AS final, p_size AS cluster, p_type, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT p_size AS cluster, p_size % 4 AS final, count(*) AS size FROM part GROUP BY ALL)
    SELECT p.final, p_type, round(sum(n) / (SELECT sum(size) FROM s WHERE s.final = p.final), 4) AS share FROM p GROUP BY 1, 2""")
def g18(t: Tables) -> DataFrame:
    base = t("part").select("p_type", F.col("p_size").alias("cluster"))
    size = base.groupBy("cluster").agg(F.count("*").alias("size"))
    share = base.groupBy("cluster", "p_type").agg(F.count("*").alias("n")).join(size, "cluster")
    profiles = share.select((F.col("cluster") % 4).alias("final"), "cluster", "size", "p_type", (F.col("n") / F.col("size")).alias("share"))
    return A.merged_clusters(profiles, "final", "size", "p_type", "share")


COVERAGE_SQL = """(SELECT p_name, count(DISTINCT p_brand) AS groups, CAST(sum(p_size) AS DOUBLE) AS total, round(sum(p_size) / count(DISTINCT p_brand), 6) AS weight, round(count(DISTINCT p_brand) / 25, 6) AS share,
    count(DISTINCT p_brand) >= 24 OR (count(DISTINCT p_brand) >= 15 AND (p_name IN ('red gear', 'old rod') OR contains(p_name, 'bolt') OR length(p_name) <= 7)) AS common FROM part GROUP BY 1)"""
SPECIFIC_SQL = f"""n AS (SELECT p_brand, p_name, CAST(sum(p_size) AS DOUBLE) AS n FROM part GROUP BY ALL), h AS (SELECT *, CASE WHEN p_brand LIKE '%1' THEN ['red gear', 'bolt', 'a hot widget'] ELSE [] END AS rh, ['anvil', 'hot gizmo'] AS ch, CASE WHEN p_brand LIKE '%2' THEN ['rod'] ELSE [] END AS pe FROM n),
    s AS (SELECT p_brand, p_name, n, groups, round(n * ln(((SELECT count(*) FROM {COVERAGE_SQL}) + 1.0) / (groups + 1)) * CASE WHEN list_contains(rh, p_name) THEN 3.0 WHEN len(list_filter(rh, lambda x: contains(p_name, x) OR contains(x, p_name))) > 0 THEN 2.3 ELSE 1 END
      * CASE WHEN list_contains(ch, p_name) THEN 1.8 WHEN len(list_filter(ch, lambda x: contains(p_name, x) OR contains(x, p_name))) > 0 THEN 1.35 ELSE 1 END * CASE WHEN groups <= 3 THEN 1.15 ELSE 1 END * CASE WHEN common THEN 0.28 ELSE 1 END * CASE WHEN contains(p_name, 'small') THEN 0.85 ELSE 1 END, 9) AS specific
      FROM h JOIN {COVERAGE_SQL} USING (p_name) WHERE p_name NOT IN ('cold gear', 'old ring') AND len(list_filter(pe, lambda x: contains(p_name, x))) = 0)"""


def coverages(t: Tables) -> DataFrame:
    return A.coverage(t("part").withColumn("p_name", F.concat(F.lit(" "), "p_name")), "p_name", "p_brand", "p_size", F.lit(25), ["red gear", "old rod"], ["bolt"], 24, 15, 7)


@R.add("g19_coverage", f"SELECT * FROM {COVERAGE_SQL}")
def g19(t: Tables) -> DataFrame:
    return coverages(t).select("p_name", "groups", "total", "weight", "share", "common")


@R.add("g21_specificity", f"WITH {SPECIFIC_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY specific DESC, n DESC, groups, length(p_name) DESC, p_name) AS rank FROM s) SELECT p_brand, p_name, round(specific, 6) AS specific, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 6")
def g21(t: Tables) -> DataFrame:
    rows = t("part").groupBy("p_brand", "p_name").agg(F.sum("p_size").alias("n"))
    none = F.array().cast("array<string>")
    hints = F.when(F.endswith("p_brand", F.lit("1")), F.array(F.lit("red gear"), F.lit("bolt"), F.lit("a hot widget"))).otherwise(none)
    penalties = F.when(F.endswith("p_brand", F.lit("2")), F.array(F.lit("rod"))).otherwise(none)
    stats = coverages(t)
    found = A.specificity(rows, "p_brand", "p_name", "n", stats, stats.count(), 6, hints, F.array(F.lit("anvil"), F.lit("hot gizmo")), penalties, ["cold gear"], ["old ring"], ["small"])
    return found.select("p_brand", "p_name", F.round("specific", 6).alias("specific"), "rank")


@R.add("g22_fan_out_cap", """SELECT p_name, list_sort(list(DISTINCT p_brand)) AS roles FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) <= 12 OR starts_with(p_name, 'red')""")
def g22(t: Tables) -> DataFrame:
    own = t("part").where("p_name LIKE 'red%'").select("p_name")
    return Y.term_roles(t("part"), "p_name", "p_brand", own)


@R.add("g23_conflicts", """WITH v AS (SELECT p_partkey AS o, p_brand || '-' || CAST(p_partkey % 97 AS INTEGER) AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN [upper(p_type) || (p_partkey % 150)] END AS a FROM part), f AS (SELECT id, min(o) AS f FROM v GROUP BY 1), k AS (SELECT v.* FROM v JOIN f USING (id) WHERE o = f),
    e AS (SELECT DISTINCT o, id, lower(unnest(list_concat([name, replace(id, '-', ' '), id], coalesce(a, [])))) AS alias FROM k), w AS (SELECT alias, arg_min(id, o) AS kept FROM e GROUP BY 1)
    SELECT 'dup_id' AS kind, id, CAST(NULL AS VARCHAR) AS alias, id AS kept FROM v JOIN f USING (id) WHERE o > f UNION ALL SELECT 'dup_alias', id, alias, kept FROM e JOIN w USING (alias) WHERE id <> kept""")
def g23(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    ids = F.concat("p_brand", F.lit("-"), (k % 97).cast("int").cast("string"))
    aliases = F.when(k % 2 == 0, F.array(F.concat(F.upper("p_type"), (k % 150).cast("string"))))
    return A.vocabulary_conflicts(t("part").select(k.alias("o"), ids.alias("id"), F.col("p_name").alias("name"), aliases.alias("a")), "o", "id", "name", "a")[1]


@R.add("g24_spelling_groups", """SELECT lower(p_name) AS key, list_sort([p_name, upper(p_name)]) AS spellings, count(*) AS n FROM part GROUP BY p_name HAVING bool_or(p_size % 2 = 0) AND bool_or(p_size % 2 = 1)""")
def g24(t: Tables) -> DataFrame:
    s = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    rows = t("part").select(s.alias("s"))
    return A.spelling_groups(rows, N.basic_key(F.col("s")), "s")


@R.add("g24_frequent_keys", "SELECT lower(p_name) AS key, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def g24_keys(t: Tables) -> DataFrame:
    s = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return A.most_frequent(t("part").select(N.basic_key(s).alias("key")), ["key"], 20)


@R.add("g25_by_category", "SELECT p_type, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY 1")
def g25(t: Tables) -> DataFrame:
    return t("part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("names"))


@R.add("g26_resources_per_skill", """WITH b AS (SELECT l_partkey, l_suppkey, l_returnflag, max(l_discount) AS s, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, o, l_suppkey) AS rank FROM b), c AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS resources, count(DISTINCT l_returnflag) AS sources FROM b GROUP BY 1)
    SELECT l_partkey, l_suppkey, CAST(rank AS INTEGER) AS rank, resources, sources FROM r JOIN c USING (l_partkey) WHERE rank <= 3""")
def g26(t: Tables) -> DataFrame:
    return Y.resource_groups(t("lineitem"), "l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_orderkey", 3)


@R.add("g27_batch_report", """SELECT count(*) AS total, count(*) FILTER (o_totalprice > 100000) AS covered, round(avg((o_totalprice > 100000)::INT), 6) AS coverage, round(avg(o_totalprice), 2) AS mean FROM orders""")
def g27(t: Tables) -> DataFrame:
    good = F.col("o_totalprice") > 100000
    return t("orders").agg(F.count("*").alias("total"), F.count_if(good).alias("covered"), F.round(F.avg(good.cast("double")), 6).alias("coverage"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@R.add("g30_decision_check", """SELECT 'undecided' AS kind, CAST(c_nationkey AS BIGINT) AS id FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)
    UNION ALL SELECT 'unknown', n_nationkey FROM (SELECT n_nationkey + 10 AS n_nationkey FROM nation) WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def g30(t: Tables) -> DataFrame:
    used = t("customer").select(F.col("c_nationkey").cast("long").alias("id")).distinct()
    decided = t("nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("id"))
    known = t("nation").select((F.col("n_nationkey") + 10).cast("long").alias("id"))
    a = O.only_in_first(used, decided, ["id"]).select(F.lit("undecided").alias("kind"), "id")
    return a.unionByName(O.only_in_first(known, used, ["id"]).select(F.lit("unknown").alias("kind"), "id"))


@R.add("g31_label_summary", """WITH e AS (SELECT DISTINCT p_type, unnest([p_brand, p_name]) AS l FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY l) AS k FROM e), n AS (SELECT p_type, count(*) AS rows FROM part GROUP BY 1) SELECT p_type, any_value(rows) AS rows, count(*) AS labels, list(l ORDER BY k) FILTER (k <= 5) AS samples FROM r JOIN n USING (p_type) GROUP BY 1""")
def g31(t: Tables) -> DataFrame:
    return Y.label_summary(t("part").select("p_type", F.array("p_brand", "p_name").alias("labels")), "p_type", "labels")


@R.add("g18_core_and_optional", """WITH i AS (SELECT p_size % 4 AS final, unnest([p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || '!', CASE WHEN length(p_brand) = 7 AND p_size % 4 > 0 THEN 'short' ELSE 'x' || p_size END, CASE WHEN p_size % 4 > 1 THEN 'part' ELSE 'y' || p_size END]) AS item FROM part), z AS (SELECT p_size % 4 AS final, count(*) AS size FROM part GROUP BY 1),
    m AS (SELECT final, item, round(count(*) / any_value(size), 4) AS share FROM i JOIN z USING (final) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY final ORDER BY share DESC, item) AS k, count(*) FILTER (share >= 0.2) OVER (PARTITION BY final) AS strict, count(*) FILTER (share >= 0.12) OVER (PARTITION BY final) AS near FROM m WHERE share >= 0.08),
    c AS (SELECT *, least(5, greatest(strict, least(near, 3))) AS n FROM r) SELECT final, coalesce(list(item ORDER BY k) FILTER (k <= n), []) AS core, coalesce(list(item ORDER BY k) FILTER (k > n AND k <= n + 5), []) AS optional FROM c GROUP BY 1""")
def g18_core(t: Tables) -> DataFrame:
    s = F.col("p_size")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    brand = F.when((F.length("p_brand") == 7) & (s % 4 > 0), "short").otherwise(F.concat(F.lit("x"), s))
    items = F.array("p_type", word(1), F.concat(word(2), F.lit("!")), brand, F.when(s % 4 > 1, "part").otherwise(F.concat(F.lit("y"), s)))
    base = t("part").select(s.alias("cluster"), F.explode(items).alias("item"))
    size = t("part").groupBy(s.alias("cluster")).agg(F.count("*").alias("size"))
    share = base.groupBy("cluster", "item").agg(F.count("*").alias("n")).join(size, "cluster")
    profiles = share.select((F.col("cluster") % 4).alias("final"), "cluster", "size", "item", (F.col("n") / F.col("size")).alias("share"))
    return Y.core_and_optional(profiles, "final", "size", "item", "share")
