"""Retrieval, ranking and graphs over documents, benchmark, embeddings and the order schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators import graphs as G
from harborline.operators import relational as O
from harborline.operators import retrieval as V
from harborline.plans.registry import Registry, Tables

R = Registry()
WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def words(c: str = "text"):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


@R.add("r01_bm25", f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest({WORDS}) AS w FROM benchmark) GROUP BY ALL),
    tf AS (SELECT doc_id, l, w, count(*) AS f FROM (SELECT doc_id, len(w) AS l, unnest(w) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT item_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (w) JOIN q USING (w), n GROUP BY ALL)
    SELECT item_id, doc_id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 5) DESC, doc_id) <= 10""")
def r01(t: Tables) -> DataFrame:
    docs, items = t("documents").select("doc_id", words().alias("w")), t("benchmark").select("item_id", words().alias("w"))
    return V.bm25_top(docs, "doc_id", "w", items, "item_id", "w", 10)


@R.add("r01_bm25_by_role", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS role, {WORDS} AS w FROM documents), n AS (SELECT role, count(*) AS n, avg(len(w)) AS mean FROM d GROUP BY 1),
    q AS (SELECT role, w, count(*) AS times FROM (SELECT 'src' || item_id % 20 AS role, unnest({WORDS}) AS w FROM benchmark) GROUP BY ALL), tf AS (SELECT role, doc_id, l, w, count(*) AS f FROM (SELECT role, doc_id, len(w) AS l, unnest(w) AS w FROM d) SEMI JOIN q USING (role, w) GROUP BY ALL),
    df AS (SELECT role, w, count(*) AS df FROM tf GROUP BY ALL), s AS (SELECT role, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (role, w) JOIN q USING (role, w) JOIN n USING (role) GROUP BY ALL)
    SELECT role, doc_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY role ORDER BY round(score, 5) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def r01_by_role(t: Tables) -> DataFrame:
    """Each role's candidates by its own query; one role has over a third of the documents."""
    role = F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source"))
    docs = t("documents").select("doc_id", role.alias("role"), words().alias("w"))
    items = t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("role"), words().alias("q"))
    return V.bm25_by_group(docs, "role", "doc_id", "w", items, "q", 10)


@R.add("r02_alignment", """WITH b AS (SELECT event_id, event_type, 0.5 + 0.5 * tanh((value - 20) / 5) AS x FROM events) SELECT event_id, round(greatest(0, least(1, CASE WHEN event_type = 'error' THEN 1 - x ELSE x END + CASE WHEN event_type = 'purchase' THEN 0.2 ELSE 0 END)), 6) AS fit FROM b""")
def r02(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    a = V.alignment(F.col("value") - 20, kind == "error", F.when(kind == "purchase", 0.2).otherwise(0.0))
    return t("events").select("event_id", F.round(a, 6).alias("fit"))


@R.add("r04_url_then_title", """WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1)
    SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, CASE WHEN user_id % 3 = 0 THEN '' ELSE props END ORDER BY value DESC, event_id) AS s FROM a) WHERE s = 1 OR user_id % 3 = 0""")
def r04(t: Tables) -> DataFrame:
    e = t("events").withColumn("title", F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("props")))
    return V.first_by_url_then_title(e, "event_type", "user_id", "title", [F.col("value").desc(), F.col("event_id")]).select("event_id")


TOP_SQL = """(SELECT a.vec_id AS query_id, b.vec_id, a.label AS ql, b.label AS il, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"""


def nearest(t: Tables, n: int) -> DataFrame:
    e = t("embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    return V.cosine_top(e, "vec_id", "embedding", q, "query_id", "qe", n)


@R.add("r11_cosine_top", f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM {TOP_SQL} WHERE rank <= 10")
def r11(t: Tables) -> DataFrame:
    return nearest(t, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@R.add("r13_skill_gap", """SELECT b.item_id, list_filter(string_split(b.text, ' '), lambda x: list_contains(list_transform(string_split(coalesce(c.text, ''), ' '), lambda y: lower(y)), lower(x))) AS have,
    len(list_filter(string_split(b.text, ' '), lambda x: NOT list_contains(list_transform(string_split(coalesce(c.text, ''), ' '), lambda y: lower(y)), lower(x)))) AS missing FROM benchmark b LEFT JOIN benchmark c ON c.item_id = b.item_id + 1""")
def r13(t: Tables) -> DataFrame:
    b = t("benchmark").select("item_id", F.split("text", " ", -1).alias("need"))
    c = t("benchmark").select((F.col("item_id") - 1).alias("item_id"), F.split("text", " ", -1).alias("owned"))
    have, missing = V.skill_gap(F.coalesce("owned", F.array()), F.col("need"))
    return b.join(c, "item_id", "left").select("item_id", have.alias("have"), F.size(missing).cast("long").alias("missing"))


@R.add("r14_linear_rerank", f"""WITH r AS (SELECT query_id, vec_id, round(0.5 * score + 0.2 * (il % 3) / 2.0 - 0.02 * (vec_id % 7), 6) AS s FROM {TOP_SQL} WHERE rank <= 20) SELECT query_id, vec_id, s FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5""")
def r14(t: Tables) -> DataFrame:
    near = nearest(t, 20).join(t("embeddings").select("vec_id", "label"), "vec_id")
    s = 0.5 * F.col("score") + 0.2 * (F.col("label") % 3) / 2.0 - 0.02 * (F.col("vec_id") % 7)
    return O.top_per_key(near.withColumn("s", F.round(s, 6)), ["query_id"], [F.col("s").desc(), F.col("vec_id")], 5).select("query_id", "vec_id", "s")


@R.add("r16_ranking_metrics", f"""WITH r AS (SELECT *, ql = il AS rel FROM {TOP_SQL} WHERE rank <= 10), n AS (SELECT a.vec_id AS query_id, count(*) AS total FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1)
    SELECT r.query_id, max((rel AND rank = 1)::INT) AS hit1, max(rel::INT) AS hitk, round(coalesce(max(CASE WHEN rel THEN 1.0 / rank END), 0), 6) AS mrr,
    round(sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(generate_series(1, least(any_value(n.total), 10))) AS i)), 6) AS ndcg FROM r JOIN n USING (query_id) GROUP BY r.query_id""")
def r16(t: Tables) -> DataFrame:
    e = t("embeddings")
    label = e.select("vec_id", "label")
    near = nearest(t, 10).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    per = label.groupBy("label").agg((F.count("*") - 1).alias("total"))
    totals = label.join(per, "label").select(F.col("vec_id").alias("query_id"), "total")
    m = V.ranking_metrics(near.withColumn("rel", F.col("label") == F.col("ql")), "query_id", "rel", totals, "total", 10)
    return m.select("query_id", "hit1", "hitk", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@R.add("r17_sensitivity", f"""WITH g AS (SELECT unnest([0.01, 0.02, 0.05]) AS gamma), r AS (SELECT query_id, gamma, ql = il AS rel, row_number() OVER (PARTITION BY query_id, gamma ORDER BY round(score - gamma * (vec_id % 7), 9) DESC, vec_id) AS rank FROM {TOP_SQL}, g WHERE rank <= 20),
    n AS (SELECT a.vec_id AS query_id, count(b.vec_id) AS total FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1), b AS (SELECT query_id, total, coalesce(list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1))), 0) AS best FROM n),
    m AS (SELECT gamma, query_id, max((rel AND rank = 1)::INT) AS hit1, max(rel::INT) AS hitk, coalesce(max(CASE WHEN rel THEN 1.0 / rank END), 0) AS mrr, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r WHERE rank <= 10 GROUP BY 1, 2)
    SELECT gamma, round(avg(hit1), 6) AS hit1, round(avg(hitk), 6) AS hitk, round(avg(mrr), 6) AS mrr, round(avg(CASE WHEN total > 0 THEN dcg / best ELSE 0 END), 6) AS ndcg FROM m JOIN b USING (query_id) GROUP BY 1""")
def r17(t: Tables) -> DataFrame:
    label = t("embeddings").select("vec_id", "label")
    near = nearest(t, 20).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    near = near.select("query_id", "vec_id", "score", (F.col("vec_id") % 7).alias("penalty"), (F.col("label") == F.col("ql")).alias("rel"))
    per = label.groupBy("label").agg((F.count("*") - 1).alias("total"))
    totals = label.where("vec_id % 100 = 0").join(per, "label").select(F.col("vec_id").alias("query_id"), "total")
    return V.swept_metrics(near, "query_id", "vec_id", "score", "penalty", "rel", totals, "total", [0.01, 0.02, 0.05], 10)


@R.add("r18_extraction_scores", f"""WITH w AS (SELECT b.item_id, list_distinct(string_split(b.text, ' ')) AS g, list_distinct(string_split(coalesce(c.text, ''), ' ')) AS f FROM benchmark b LEFT JOIN benchmark c ON c.item_id = b.item_id + 1),
    s AS (SELECT CAST(sum(len(list_intersect(g, f))) AS BIGINT) AS tp, CAST(sum(len(f) - len(list_intersect(g, f))) AS BIGINT) AS fp, CAST(sum(len(g) - len(list_intersect(g, f))) AS BIGINT) AS fn FROM w)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""")
def r18(t: Tables) -> DataFrame:
    b = t("benchmark").select("item_id", F.split("text", " ", -1).alias("g"))
    c = t("benchmark").select((F.col("item_id") - 1).alias("item_id"), F.split("text", " ", -1).alias("f"))
    return V.extraction_scores(b.join(c, "item_id", "left").withColumn("f", F.coalesce("f", F.array(F.lit("")))), "g", "f")


@R.add("r23_tiered", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 10000 END AS a, CASE WHEN c_custkey % 3 < 2 THEN (c_custkey % 11) / 11.0 END AS g, (c_custkey % 7) / 7.0 AS o, range(c_custkey % 9) AS l FROM customer)
    SELECT c_custkey, CASE WHEN a IS NOT NULL THEN 1 WHEN g IS NOT NULL THEN 2 ELSE 3 END AS tier, round(coalesce(a, CASE WHEN g IS NOT NULL THEN greatest(g, o) END, o), 4) AS score, l[1:5] AS missing FROM c""")
def r23(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    full, graph = F.when(k % 3 == 0, F.col("c_acctbal") / 10000), F.when(k % 3 < 2, k % 11 / 11.0)
    missing = F.when(k % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), k % 9 - 1))
    x = V.tiered(full, graph, k % 7 / 7.0, {"missing": missing})
    return t("customer").select("c_custkey", x.alias("x")).select("c_custkey", "x.*")


EDGES_SQL = "(SELECT DISTINCT p_partkey AS src, p_partkey // d AS dst FROM part, (SELECT unnest([2, 3]) AS d) WHERE p_partkey > 0)"


def edges(t: Tables) -> DataFrame:
    p = t("part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.explode(F.array(F.lit(2), F.lit(3))).alias("d"))
    return p.select("src", F.expr("src div d").alias("dst")).distinct()


def nodes(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("node"))


def skills(t: Tables) -> DataFrame:
    """Parts as skills that need the parts of half and a third of their number, and one that is not there."""
    k, s = F.col("p_partkey"), F.col("p_size")
    hard = F.when(F.col("p_type") == "SMALL", "Beginner").when(F.col("p_type") == "LARGE", "advanced").otherwise("any")
    before = F.array_distinct(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"), k + 1000000))
    return t("part").select(k.alias("skill"), (s % 5 + 1).alias("level"), hard.alias("difficulty"), (s * 4).alias("hours"), F.when(k > 0, before).otherwise(F.array()).alias("prerequisites"))


@R.add("p01_top_weights", """WITH s AS (SELECT p_brand, count(*) AS size FROM part GROUP BY 1), i AS (SELECT p_brand, p_name AS skill, round(count(*) / any_value(size), 4) AS w FROM part JOIN s USING (p_brand) WHERE length(p_brand) = 8 GROUP BY 1, 2 UNION ALL SELECT DISTINCT p_brand, p_type, CASE WHEN starts_with(p_type, 'S') THEN 1.05 ELSE 1.0 END FROM part WHERE length(p_brand) = 7
    UNION ALL SELECT DISTINCT p_brand, p_name, 0.65 FROM part WHERE length(p_brand) = 7 UNION ALL SELECT DISTINCT p_brand, p_type, 0.65 FROM part WHERE length(p_brand) = 7), m AS (SELECT p_brand, skill, max(w) AS weight FROM i GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, skill) AS rank FROM m)
    SELECT p_brand, skill, CAST(weight AS DOUBLE) AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30""")
def p01(t: Tables) -> DataFrame:
    """Brands of two digits have shares of names; others lists of types and names."""
    part = t("part")
    size = part.groupBy("p_brand").agg(F.count("*").alias("size"))
    share = part.where("length(p_brand) = 8").groupBy("p_brand", "p_name").agg(F.count("*").alias("n")).join(size, "p_brand")
    freq = share.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_name", F.round(F.col("n") / F.col("size"), 4)))).alias("freq"))
    lists = part.groupBy("p_brand").agg(F.collect_set("p_type").alias("required"), F.collect_set("p_name").alias("names"))
    rows = lists.join(freq, "p_brand", "left").withColumn("core", F.filter("required", lambda x: x.startswith("S")))
    rows = rows.withColumn("optional", F.concat("names", "required"))
    return G.role_skills(rows, "p_brand", "freq", "required", "core", "optional").select("p_brand", "skill", "weight", "rank")


UNIT_SQL = "CASE WHEN sqrt(list_sum(list_transform(v, lambda x: x * x))) <= 1e-8 THEN v ELSE list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) END"


@R.add("p02_node_features", f"""WITH s AS (SELECT p_partkey, p_brand, p_size, p_size % 5 + 1 AS level, CASE p_type WHEN 'SMALL' THEN 1.0 WHEN 'LARGE' THEN 3.0 ELSE 2.0 END AS d, p_size * 5 AS hours FROM part), j AS (SELECT p_brand, avg(p_size / 50.0) AS a, max(p_size / 50.0) AS m, avg((p_size > 25)::INT) AS c, avg(CASE WHEN p_partkey % 10 > 0 THEN level ELSE 1 END) AS l, avg(CASE WHEN p_partkey % 10 > 0 THEN hours ELSE 0 END) AS h FROM s WHERE p_brand <> 'Brand#1' GROUP BY 1),
    n AS (SELECT 'skill' AS kind, CAST(p_partkey AS VARCHAR) AS id, [level / 5.0, d / 3.0, least(hours / 200.0, 1), (p_size > 40)::INT] AS v FROM s UNION ALL SELECT 'job', p_brand, coalesce([a, m, c, l / 5.0, least(h / 200.0, 1)], [0.0, 0, 0, 0, 0]) FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT *, true AS there FROM j) USING (p_brand) WHERE there
      UNION ALL SELECT 'job', 'Brand#1', [0.0, 0, 0, 0, 0] WHERE EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#1') UNION ALL SELECT 'resource', CAST(s_suppkey AS VARCHAR), [CASE s_nationkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.5 END, CASE s_suppkey % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 1.0 END / 3, least(s_suppkey % 150 / 100.0, 1), least(CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey % 9 ELSE 1 END / 5.0, 1)] FROM supplier)
    SELECT kind, id, {UNIT_SQL} AS v FROM (SELECT kind, id, CAST(v AS DOUBLE[]) AS v FROM n)""")
def p02(t: Tables) -> DataFrame:
    """Parts as skills, brands as jobs (one without skills), suppliers as resources."""
    part, k, size = t("part"), F.col("p_partkey"), F.col("p_size")
    kind = lambda df, name, key, v: df.select(F.lit(name).alias("kind"), key.cast("string").alias("id"), v.alias("v"))
    hard = F.when(F.col("p_type") == "SMALL", "Beginner").when(F.col("p_type") == "LARGE", "advanced").when(F.col("p_type") == "PROMO", "odd")
    skills = kind(part, "skill", k, G.skill_features(size % 5 + 1, hard, size * 5, size > 40))
    needs = part.where("p_brand <> 'Brand#1'").select("p_brand", k.alias("skill"), (size / 50.0).alias("weight"), (size > 25).alias("core"))
    known = part.where(k % 10 > 0).select(k.alias("skill"), (size % 5 + 1).alias("level"), (size * 5).alias("hours"))
    jobs = kind(G.job_features(part.select("p_brand").distinct(), "p_brand", needs, known), "job", F.col("p_brand"), F.col("v"))
    s, n = F.col("s_suppkey"), F.col("s_nationkey") % 3
    provider = F.when(n == 0, "Acme").when(n == 1, "OTHER").otherwise("who")
    level = F.when(s % 4 == 0, "advanced").when(s % 4 == 1, "intermediate").when(s % 4 == 2, "odd")
    resources = kind(t("supplier"), "resource", s, G.resource_features(provider, {"acme": 0.9, "other": 0.7}, level, s % 150, F.when(s % 9 > 0, s % 9)))
    return skills.unionByName(jobs).unionByName(resources)


@R.add("p05_dangling", f"SELECT DISTINCT dst + 7 AS node FROM {EDGES_SQL} WHERE dst + 7 NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def p05(t: Tables) -> DataFrame:
    shifted = edges(t).withColumn("dst", F.col("dst") + 7)
    return G.dangling(shifted, t("part").where("p_size > 5").select(F.col("p_partkey").alias("node")), "dst", "node")


@R.add("p06_levels", f"""WITH RECURSIVE e AS {EDGES_SQL}, l AS (SELECT 0 AS node, 0 AS level UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.dst = l.node) SELECT CAST(node AS BIGINT) AS node, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY 1""")
def p06(t: Tables) -> DataFrame:
    flipped = edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.levels(flipped, nodes(t))


@R.add("p07_closure", f"""WITH RECURSIVE e AS {EDGES_SQL}, c AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION SELECT root, e.dst, depth + 1 FROM c JOIN e ON e.src = c.node WHERE depth < 3)
    SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2""")
def p07(t: Tables) -> DataFrame:
    return G.closure(edges(t), nodes(t), 3)


@R.add("p08_cheapest", f"""WITH RECURSIVE e AS (SELECT dst AS src, src AS dst, 0.3 + 0.1 * (src % 5) AS cost FROM {EDGES_SQL}), b AS (SELECT p_partkey AS node, 0.0::DOUBLE AS cost FROM part WHERE p_partkey % 50 = 7 UNION SELECT 0, 0.4 * 0.3 UNION SELECT e.dst, round(b.cost + e.cost, 9) FROM b JOIN e ON e.src = b.node)
    SELECT node, round(min(cost), 6) AS cost FROM b GROUP BY 1""")
def p08(t: Tables) -> DataFrame:
    """From known skills at no cost, and from roots at a share of theirs."""
    e = edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (0.3 + 0.1 * (F.col("src") % 5)).alias("cost"))
    n = nodes(t).withColumn("cost", 0.3 + 0.1 * (F.col("node") % 5))
    start = G.path_starts(e, n, n.where("node % 50 = 7"))
    return G.cheapest(e, start).select("node", F.round("cost", 6).alias("cost"))


@R.add("p13_neighbour_means", f"""WITH e AS (SELECT src, dst FROM {EDGES_SQL} UNION SELECT dst, src FROM {EDGES_SQL}), v0 AS (SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 9 AS DOUBLE) AS b FROM part), m1 AS (SELECT dst AS node, avg(a) AS a, avg(b) AS b FROM e JOIN v0 ON src = node GROUP BY 1), v1 AS (SELECT v0.node, v0.a, v0.b, coalesce(m1.a, 0) AS c, coalesce(m1.b, 0) AS d FROM v0 LEFT JOIN m1 USING (node)),
    m2 AS (SELECT dst AS node, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(d) AS d FROM e JOIN v1 ON src = node GROUP BY 1), v2 AS (SELECT v1.node, [v1.a, v1.b, v1.c, v1.d, coalesce(m2.a, 0), coalesce(m2.b, 0), coalesce(m2.c, 0), coalesce(m2.d, 0)] AS v FROM v1 LEFT JOIN m2 USING (node))
    SELECT node, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 5)) AS v FROM v2""")
def p13(t: Tables) -> DataFrame:
    v = t("part").select(F.col("p_partkey").alias("node"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 9).cast("double")).alias("v"))
    return G.neighbour_embedding(edges(t), v).select("node", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@R.add("p15_strong_edges", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= (SELECT quantile_cont(l_quantity, 0.6) FROM lineitem) AND l_quantity >= 33""")
def p15(t: Tables) -> DataFrame:
    return G.strong_edges(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 0.6, 33)


@R.add("p18_catalog_fallback", """WITH s AS (SELECT s_nationkey AS k, s_suppkey AS r, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS p FROM supplier WHERE s_acctbal > 5000), c AS (SELECT c_nationkey AS k, c_custkey AS r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer),
    a AS (SELECT k AS skill, list(r ORDER BY p) AS resources, 'beginner' AS level, 0 AS catalog FROM s WHERE p <= 3 GROUP BY 1), b AS (SELECT k AS skill, list(r ORDER BY p) AS resources, 'advanced' AS level, 1 AS catalog FROM c WHERE p <= 3 GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE skill NOT IN (SELECT skill FROM a)""")
def p18(t: Tables) -> DataFrame:
    """Suppliers of a nation, of a level that is not known; where there are none of enough balance, its customers."""
    def listed(df: DataFrame, skill: str, resource: str, level: str) -> DataFrame:
        top = O.top_per_key(df, [skill], [F.col(resource)], 5)
        return top.groupBy(F.col(skill).alias("skill")).agg(F.array_sort(F.collect_list(resource)).alias("resources")).withColumn("level", F.lit(level))

    rich = listed(t("supplier").where("s_acctbal > 5000"), "s_nationkey", "s_suppkey", "Expert")
    none = t("nation").select(F.col("n_nationkey").alias("skill"), F.array().cast("array<bigint>").alias("resources"), F.lit("beginner").alias("level"))
    return G.catalog_with_fallback([rich.unionByName(none.join(rich, "skill", "left_anti")), listed(t("customer"), "c_nationkey", "c_custkey", "Advanced")])


@R.add("r18_extraction_rows", """WITH w AS (SELECT b.item_id, list_distinct(list_transform(string_split(b.text, ' '), lambda x: lower(x))) AS g, list_distinct(list_transform(string_split(coalesce(c.text, ''), ' '), lambda x: lower(x))) AS f, length(b.text) % 3 AS a, length(c.text) % 3 AS p FROM benchmark b LEFT JOIN benchmark c ON c.item_id = b.item_id + 1)
    SELECT item_id, len(list_intersect(g, f)) AS tp, len(f) - len(list_intersect(g, f)) AS fp, len(g) - len(list_intersect(g, f)) AS fn, list_sort(list_filter(g, lambda x: NOT list_contains(f, x))) AS missing, list_sort(list_filter(f, lambda x: NOT list_contains(g, x))) AS extra,
    CASE WHEN a > 0 THEN coalesce(a = p, false) END AS level_right, coalesce(abs(a + 0.05 - p) <= 0.1, false) AS years_right FROM w""")
def r18_rows(t: Tables) -> DataFrame:
    n = F.length("text") % 3
    b = t("benchmark").select("item_id", F.split("text", " ", -1).alias("g"), F.when(n > 0, n).alias("level"), (n + 0.05).alias("years"))
    c = t("benchmark").select((F.col("item_id") - 1).alias("item_id"), F.split("text", " ", -1).alias("f"), n.alias("level_found"), n.cast("double").alias("years_found"))
    rows = b.join(c, "item_id", "left").withColumn("f", F.coalesce("f", F.array(F.lit(""))))
    return V.extraction_rows(rows, "item_id", "g", "f", {"level": ("level_found", None), "years": ("years_found", 0.1)})


@R.add("p03_prerequisite_cost", """WITH s AS (SELECT p_partkey AS skill, p_size % 5 + 1 AS level, CASE p_type WHEN 'SMALL' THEN 1.0 WHEN 'LARGE' THEN 3.0 ELSE 2.0 END AS d, p_size * 4 AS hours, unnest(list_distinct([p_partkey // 2, p_partkey // 3, p_partkey + 1000000])) AS pre FROM part WHERE p_partkey > 0)
    SELECT pre AS src, skill AS dst, 'requires' AS relation, round(0.30 + 0.08 * level + 0.10 * d + least(hours / 160.0, 0.8), 4) AS weight FROM s WHERE pre IN (SELECT p_partkey FROM part)""")
def p03_prerequisites(t: Tables) -> DataFrame:
    return G.prerequisite_edges(skills(t))


@R.add("p04_unified_graph", """WITH n AS (SELECT r_name AS id, 'region' AS kind FROM region UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT DISTINCT p_name, 'part' FROM part), e AS (SELECT DISTINCT n_name AS src, r_name AS dst, 'in' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT p_name, p_brand, 'made by' FROM part)
    SELECT 'node' AS what, kind, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'loose', relation, count(*) FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n) GROUP BY 2""")
def p04(t: Tables) -> DataFrame:
    """Nations given twice, the second time as another kind; edges given twice; brands are no nodes."""
    part = lambda df, c, k: df.select(F.col(c).alias("id"), F.lit(k).alias("kind"))
    within = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in").alias("relation"))
    made = t("part").select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.lit("made by").alias("relation"))
    n = G.unified_nodes([part(t("region"), "r_name", "region"), part(t("nation"), "n_name", "nation"), part(t("nation"), "n_name", "twice"), part(t("part"), "p_name", "part")], "id")
    return G.graph_summary(n, G.unified_edges([within, made, within]), "kind")


@R.add("p06_dag_report", f"""WITH RECURSIVE e AS {EDGES_SQL}, l AS (SELECT 0 AS node, 0 AS level UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.dst = l.node)
    SELECT (SELECT count(*) FROM part) + 6 AS nodes, (SELECT count(*) FROM e) + 6 AS edges, CAST(1 AS BIGINT) AS roots, CAST((SELECT max(level) FROM l) AS INTEGER) AS depth, CAST(6 AS BIGINT) AS cyclic, false AS acyclic""")
def p06_report(t: Tables) -> DataFrame:
    """The parts, and beside them a ring of the regions with a node behind it."""
    r = F.col("r_regionkey").cast("long")
    ring = t("region").select((-1 - r).alias("src"), (-1 - (r + 1) % 5).alias("dst"))
    tail = t("region").where("r_regionkey = 0").select((-1 - r).alias("src"), F.lit(-9).cast("long").alias("dst"))
    flipped = edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    every = flipped.unionByName(ring).unionByName(tail)
    return G.dag_report(every, nodes(t).unionByName(ring.select(F.col("src").alias("node"))).unionByName(tail.select(F.col("dst").alias("node"))))


@R.add("p20_path_subgraph", """WITH o AS (SELECT o_custkey AS k, o_orderkey AS s, o_orderdate AS d, o_orderstatus = 'F' AS own, o_totalprice > 200000 AS want FROM orders) SELECT k, 'edge' AS kind, lag(s) OVER w AS a, s AS b, NULL AS tag FROM o WINDOW w AS (PARTITION BY k ORDER BY d, s) QUALIFY a IS NOT NULL
    UNION ALL SELECT k, 'node', s, NULL, CASE WHEN own AND want THEN 'overlap' WHEN want THEN 'missing' ELSE 'bridge' END FROM o""")
def p20(t: Tables) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("s"), "o_orderdate", "o_orderstatus", "o_totalprice")
    found, chain = G.path_subgraph(o, "k", "o_orderdate", "s", o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 200000"))
    n = found.select("k", F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "tag")
    return n.unionByName(chain.select("k", F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("string").alias("tag")))
