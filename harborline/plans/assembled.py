"""Operators put together: merged lists, batch evidence, forecasts, clusters and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators import aggregates as A
from harborline.operators import clusters as K
from harborline.operators import graphs as G
from harborline.operators import matching as M
from harborline.operators import relational as O
from harborline.operators import retrieval as V
from harborline.operators import roles as X
from harborline.operators import scoring as C
from harborline.operators import series as S
from harborline.operators import taxonomy as Y
from harborline.operators import titles as L
from harborline.plans.registry import Registry, Tables
from harborline.plans.retrieval import EDGES_SQL, edges
from harborline.plans.series import DENSE_SQL, dense

R = Registry()


def _aliases(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(pairs, "alias string, name string")


@R.add("m05_capped_matches", """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9+#]+') AS w FROM benchmark), h AS (SELECT item_id, unnest(list_filter(['the','than','is','of','inin'], lambda x: list_contains(w, x))) AS k FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(k) DESC, k) AS p FROM h) SELECT item_id, list(k ORDER BY p) AS terms FROM r WHERE p <= 3 GROUP BY 1""")
def m05(t: Tables) -> DataFrame:
    names = ["the", "than", "is", "of", "inin"]
    found = M.dictionary_matches(t("benchmark"), "item_id", "text", _aliases(t("benchmark"), [(n, n) for n in names]), 1, 100)
    ranked = F.array_sort(F.transform("names", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("k"))))
    return found.select("item_id", F.transform(F.slice(ranked, 1, 3), lambda x: x["k"]).alias("terms"))


@R.add("m06_merged_lists", """WITH x AS (SELECT p_partkey, list_concat(list_filter([lower(trim(p_type)), CASE WHEN p_size % 3 > 0 THEN split_part(p_name, ' ', 2) ELSE '' END], lambda s: s <> ''), string_split(p_name, ' ')) AS l, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN NULL ELSE 'p' || p_partkey END AS given, p_name, p_brand FROM part),
    y AS (SELECT *, list_filter(l, lambda s, i: list_position(l, s) = i) AS skills FROM x) SELECT p_partkey, array_to_string(skills, ',') AS skills, len(skills) AS n, coalesce(nullif(given, ''), 'part_' || substr(md5(p_name || '|' || p_brand), 1, 12)) AS id FROM y""")
def m06(t: Tables) -> DataFrame:
    k, second = F.col("p_partkey") % 4, F.split_part("p_name", F.lit(" "), F.lit(2))
    raw = F.concat(F.lit(" "), "p_type", F.lit(" , "), F.when(F.col("p_size") % 3 > 0, second).otherwise(" "), F.lit(","))
    given = F.when(k == 0, "").when(k > 1, F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    rows = t("part").select("p_partkey", M.merged_skills(raw, F.split("p_name", " ")).alias("s"), M.record_id(given, F.lit("part"), F.col("p_name"), F.col("p_brand")).alias("id"))
    return rows.select("p_partkey", F.array_join("s", ",").alias("skills"), F.size("s").cast("long").alias("n"), "id")


@R.add("m07_alias_scan", """WITH d AS (SELECT doc_id, lower(text) || CASE WHEN doc_id % 3 = 0 THEN ' 大数据分析' ELSE ' c++' END AS x FROM documents)
    SELECT doc_id, list_filter([CASE WHEN contains(x, '数据') THEN 'data' END, CASE WHEN regexp_matches(x, '(^|[^a-z0-9+#])(con|mit)($|[^a-z0-9+#])') THEN 'with' END, CASE WHEN regexp_matches(x, '(^|[^a-z0-9+#])c($|[^a-z0-9+#])') THEN 'c' END], lambda n: n IS NOT NULL) AS names FROM d""")
def m07(t: Tables) -> DataFrame:
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " 大数据分析").otherwise(" C++"))
    aliases = {"data": ["数据"], "with": ["con", "mit"], "c": ["c"]}
    return t("documents").select("doc_id", M.canonical_scan(text, aliases).alias("names"))


@R.add("m14_focused_or_all", """WITH r AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'main' ELSE 'x' END AS alias, n_nationkey % 4 AS s FROM nation) SELECT n_nationkey, 'some' AS kind FROM r WHERE contains(n_name, '_1') OR alias = 'main' OR s >= 2 UNION ALL SELECT n_nationkey, 'none' FROM nation""")
def m14(t: Tables) -> DataFrame:
    """By hints that some roles have, and by hints that none has."""
    k = F.col("n_nationkey")
    skills = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= k % 4, "maintain").otherwise("cook"))
    r = t("nation").select("n_nationkey", "n_name", F.array(F.when(k % 5 == 0, "Main").otherwise("x")).alias("aliases"), skills.alias("skills"))
    some = X.focused_or_all(r, "n_name", "aliases", "skills", ["_1", "ai"]).select("n_nationkey", F.lit("some").alias("kind"))
    return some.unionByName(X.focused_or_all(r, "n_name", "aliases", "skills", ["zz"]).select("n_nationkey", F.lit("none").alias("kind")))


@R.add("m17_bucket_or_default", """SELECT p_partkey, CASE WHEN contains(p_name,'bolt') OR contains(p_name,'ring') THEN 'metal' WHEN contains(p_name,'gear') THEN 'machine' ELSE 'general' END AS bucket FROM part""")
def m17(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", M.first_rule(F.col("p_name"), {"metal": ["bolt", "ring"], "machine": ["gear"]}, "general").alias("bucket"))


TITLES_SQL = """t AS (SELECT p_partkey, p_type, p_size % 10 = 0 AS bad, string_split(CASE p_size % 7 WHEN 1 THEN '12 ' || p_size WHEN 2 THEN p_name || ' it hardware' WHEN 3 THEN split_part(p_name, ' ', 2) ELSE p_name END, ' ') AS w FROM part),
    f AS (SELECT *, len(list_intersect(w, ['bolt', 'gear', 'anvil'])) > 0 AS ctx, len(list_filter(list_intersect(w, ['red', 'blue', 'it', 'rod']), lambda x: x <> 'rod' AND length(x) >= 3)) > 0 AS sk FROM t)"""
WORD_LISTS = (["bolt", "gear", "anvil"], ["red", "blue", "it", "rod"], ["rod", "ring"])


def titles(t: Tables) -> DataFrame:
    k, name = F.col("p_size") % 7, F.col("p_name")
    title = (
        F.when(k == 1, F.concat(F.lit("12 "), F.col("p_size").cast("string"))).when(k == 2, F.concat(name, F.lit(" it hardware")))
        .when(k == 3, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(name)
    )
    return t("part").select("p_partkey", "p_type", (F.col("p_size") % 10 == 0).alias("bad"), F.split(title, " ").alias("w"))


@R.add("m23_title_quality", f"WITH {TITLES_SQL} SELECT p_partkey, round(CASE WHEN bad THEN 0.0 WHEN w[1] = '12' THEN 0.1 ELSE (0.3 + CASE WHEN ctx THEN 0.4 ELSE 0 END + CASE WHEN sk THEN 0.3 ELSE 0 END) * CASE WHEN p_type = 'PROMO' THEN 0.7 ELSE 1 END END, 6) AS quality FROM f")
def m23(t: Tables) -> DataFrame:
    return titles(t).select("p_partkey", L.title_quality(F.col("w"), F.col("bad"), *WORD_LISTS, F.col("p_type") == "PROMO").alias("quality"))


@R.add("m23_title_affinity", f"""WITH {TITLES_SQL}, r AS (SELECT * FROM (VALUES ('red gear engineer', ['red', 'gear', 'hot', 'widget', 'x1'], []), ('bolt maker', ['bolt', 'nut', 'ring', 'rod'], ['red', 'blue', 'rod', 'ring']), ('small anvil', ['anvil', 'forge', '12'], [])) v(role, a, req)),
    h AS (SELECT *, list_distinct(list_intersect(w, a)) AS hit FROM f, r) SELECT p_partkey, role, round(CASE WHEN bad OR len(hit) = 0 OR (len(req) > 0 AND len(list_intersect(w, req)) = 0) OR (len(list_filter(hit, lambda x: x NOT IN ('rod', 'ring'))) = 0 AND NOT list_contains(w, 'hardware') AND NOT sk) THEN 0.0
      ELSE 0.55 + CASE WHEN len(hit) >= 2 THEN 0.2 ELSE 0 END + CASE WHEN ctx THEN 0.15 ELSE 0 END + CASE WHEN sk THEN 0.1 ELSE 0 END END, 6) AS affinity FROM h""")
def m23_affinity(t: Tables) -> DataFrame:
    """Every title with three roles: all branches."""
    rows = [("red gear engineer", ["hot widget engineer", "x1 y"], []), ("bolt maker", ["maker of"], ["red", "blue", "rod", "ring"]), ("small anvil", ["the forge", "12"], [])]
    roles = t("part").sparkSession.createDataFrame(rows, "role string, aliases array<string>, req array<string>")
    anchors = L.role_anchors(F.col("role"), F.col("aliases"), ["engineer", "maker", "small", "the", "of"], {"bolt": ["nut", "ring", "rod"], "zzz": ["no"]})
    pairs = titles(t).join(F.broadcast(roles.withColumn("a", anchors)))  # three rows
    return pairs.select("p_partkey", "role", L.title_affinity(F.col("w"), F.col("bad"), F.col("a"), [F.col("req")], *WORD_LISTS, ["hardware"]).alias("affinity"))


@R.add("m37_curated_aliases", """WITH e AS (SELECT p_partkey, p_name, unnest([p_name, 'A ' || p_name, 'a ' || p_name, 'one', p_brand || ' ' || p_name || ' ' || p_type || p_size, 'the ' || p_partkey, 'the common', 'x ' || p_partkey, 'y ' || p_partkey, 'z ' || p_partkey]) AS a, unnest(range(10)) AS p FROM part),
    o AS (SELECT lower(a) AS a FROM e GROUP BY 1 HAVING count(DISTINCT p_partkey) <= 3), k AS (SELECT p_partkey, lower(a) AS l, arg_min(a, p) AS a, min(p) AS p FROM e WHERE lower(a) IN (SELECT a FROM o) AND lower(a) <> lower(p_name) AND contains(a, ' ') AND a <> 'y 7' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p) AS k FROM k) SELECT p_partkey, list(a ORDER BY k) AS aliases FROM r WHERE k <= 4 GROUP BY 1""")
def m37(t: Tables) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey").cast("string")
    made = F.array(
        name, F.concat(F.lit("A "), name), F.concat(F.lit("a "), name), F.lit("one"), F.concat(F.concat_ws(" ", "p_brand", "p_name", "p_type"), F.col("p_size").cast("string")),
        F.concat(F.lit("the "), k), F.lit("the common"), F.concat(F.lit("x "), k), F.concat(F.lit("y "), k), F.concat(F.lit("z "), k),
    )
    entities = t("part").select("p_partkey", "p_name", made.alias("made"))
    common = t("part").limit(1).select(F.lit("Y 7").alias("alias"))
    return X.curated_aliases(entities, "p_partkey", "p_name", "made", common)


@R.add("j07_term_in_text", """SELECT doc_id, w.term FROM documents, (SELECT unnest(['idiot', 'License', '@mail']) AS term) w WHERE contains(text, w.term)""")
def j07(t: Tables) -> DataFrame:
    terms = ["idiot", "License", "@mail"]  # a fixed list: one expression for each, no join
    hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(w)), F.lit(w)) for w in terms]))
    return t("documents").select("doc_id", F.explode(hits).alias("term"))


@R.add("g04_composite_index", f"""WITH {DENSE_SQL}, m AS (SELECT role, i, n, coalesce(CASE WHEN i % 3 > 0 THEN total END, CASE WHEN i % 2 = 0 THEN total / 2 END, 0) AS pay FROM dense)
    SELECT role, i, round(1 / (1 + exp(-(0.45 * (n - avg(n) OVER ()) / stddev_pop(n) OVER () + 0.25 * (pay - avg(pay) OVER ()) / stddev_pop(pay) OVER ()))), 6) AS score FROM m""")
def g04(t: Tables) -> DataFrame:
    i = F.col("i")
    pay = F.coalesce(F.when(i % 3 > 0, F.col("total")), F.when(i % 2 == 0, F.col("total") / 2), F.lit(0.0))
    return A.weighted_index(dense(t).withColumn("pay", pay), {"n": 0.45, "pay": 0.25}, "score").select("role", i.cast("long").alias("i"), "score")


@R.add("g28_span_summary", """WITH b AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: length(x) % 4 = 0 AND x <> '') AS s FROM benchmark), w AS (SELECT lower(unnest(s)) AS w FROM b), c AS (SELECT w, count(*) AS n FROM w GROUP BY 1), r AS (SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS k FROM c)
    SELECT (SELECT count(*) FROM b) AS rows, (SELECT count(*) FROM b WHERE len(s) > 0) AS with_spans, (SELECT count(*) FROM c) AS spans, (SELECT count(*) FROM w) AS mentions, (SELECT list(w ORDER BY k) FROM r WHERE k <= 200) AS top""")
def g28(t: Tables) -> DataFrame:
    spans = F.filter(F.split("text", " ", -1), lambda x: (F.length(x) % 4 == 0) & (x != ""))
    return Y.span_summary(t("benchmark").select(spans.alias("spans")), "spans")


@R.add("w17_direct_forecast", f"""WITH {DENSE_SQL}, e AS (SELECT role, arg_min(n, i) AS a, arg_max(n, i) AS b, max(i) - min(i) AS span FROM dense WHERE i > (SELECT max(i) FROM dense) - 24 GROUP BY 1)
    SELECT role, CAST(s AS INTEGER) AS step, round(greatest(0, b + (b - a) / span * s), 6) AS forecast FROM e, (SELECT unnest(generate_series(1, 36)) AS s)""")
def w17(t: Tables) -> DataFrame:
    """Per role 36 clipped values from the last 24 places."""
    d = dense(t)
    last = d.agg(F.max("i").alias("last"))
    recent = d.crossJoin(F.broadcast(last)).where(F.col("i") > F.col("last") - 24)  # one row
    return S.drift_forecast(recent, "role", "i", "n", 36).select("role", "step", F.round("forecast", 6).alias("forecast"))


@R.add("r12_text_vectors", """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9+#]+')) AS w FROM benchmark), c AS (SELECT item_id, ('0x' || substr(md5(w), 1, 15))::BIGINT % 4096 AS cell, count(*) AS f FROM w GROUP BY ALL), d AS (SELECT cell, count(*) AS df FROM c GROUP BY 1),
    x AS (SELECT item_id, cell, f * ln(((SELECT count(*) FROM benchmark) + 1.0) / (df + 1.0)) AS x FROM c JOIN d USING (cell)), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1)
    SELECT item_id, coalesce(list(CAST(cell AS INTEGER) ORDER BY cell) FILTER (x > 0), []) AS cells, coalesce(list(round(x / n, 6) ORDER BY cell) FILTER (x > 0), []) AS weights FROM benchmark LEFT JOIN x USING (item_id) LEFT JOIN n USING (item_id) GROUP BY 1""")
def r12(t: Tables) -> DataFrame:
    """Hashed TF-IDF vectors of the benchmark, of unit length."""
    found = K.text_vectors(t("benchmark").select("item_id", M.tokens(F.col("text")).alias("w")), "item_id", "w", 4096)
    return found.select("item_id", "cells", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"))


@R.add("r20_stratified_clusters")
def r20(t: Tables) -> DataFrame:
    """k-means of the embeddings within the strata of their labels."""
    e = t("embeddings").withColumn("bucket", F.col("label") % 2)
    return K.stratified_clusters(e, "vec_id", "bucket", "embedding", ["1"])[0].select("vec_id", "bucket", "cluster", F.round("distance", 6).alias("distance"))


@R.add("r21_cluster_names", """WITH p AS (SELECT p_size, CASE p_size % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'other' ELSE 'plain' END AS bucket, split_part(p_name, ' ', 1) AS s, split_part(p_name, ' ', 2) AS k, CASE WHEN p_size % 2 = 0 THEN 'Senior ' ELSE '' END || p_name AS ti FROM part),
    kc AS (SELECT p_size, k, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, k) AS r FROM (SELECT p_size, k, count(*) AS n FROM p GROUP BY 1, 2)), sc AS (SELECT p_size, s, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, s) AS r FROM (SELECT p_size, s, count(*) AS n FROM p GROUP BY 1, 2)), tc AS (SELECT p_size, ti, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, ti) AS r FROM (SELECT p_size, ti, count(*) AS n FROM p GROUP BY 1, 2)),
    c AS (SELECT p_size, bucket, (SELECT list(k ORDER BY r) FROM kc WHERE kc.p_size = b.p_size AND r <= 3) AS kw, (SELECT list(s ORDER BY r) FROM sc WHERE sc.p_size = b.p_size AND r <= 3) AS sk, (SELECT list(ti ORDER BY r) FROM tc WHERE tc.p_size = b.p_size AND r <= 3) AS tl FROM (SELECT DISTINCT p_size, bucket FROM p) b),
    n AS (SELECT *, coalesce(CASE WHEN contains(array_to_string(kw, ' '), 'anvil') THEN 'Smith' WHEN contains(array_to_string(kw, ' '), 'gear') THEN 'Engineer' END, CASE WHEN list_contains(sk, 'hot') THEN 'Stoker' END, CASE WHEN kw[1] NOT IN ('bolt', 'rod') THEN kw[1] END, regexp_replace(tl[1], '^Senior ', '')) AS base FROM c),
    d AS (SELECT *, row_number() OVER (PARTITION BY bucket, base ORDER BY p_size) AS i, list_filter(list_concat(kw, sk), lambda x: NOT contains(lower(base), x) AND x NOT IN ('bolt', 'rod'))[1] AS hint FROM n),
    f AS (SELECT *, CASE WHEN i > 1 THEN base || ' (' || coalesce(hint, CAST(i AS VARCHAR)) || ')' ELSE base END AS name FROM d), g AS (SELECT *, len(list_filter(sk, lambda x: x NOT IN ('red', 'small', 'old'))) AS strong FROM f)
    SELECT p_size, bucket, name FROM g WHERE NOT contains(lower(name || ' ' || array_to_string(kw, ' ') || ' ' || array_to_string(tl, ' ')), 'cold plate') AND (strong >= CASE bucket WHEN 'new' THEN 2 WHEN 'other' THEN 3 ELSE 0 END OR (bucket = 'new' AND contains(array_to_string(kw, ' '), 'ring')))""")
def r21(t: Tables) -> DataFrame:
    s = F.col("p_size")
    p = t("part").select("p_size", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("s"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("k"), F.concat(F.when(s % 2 == 0, "Senior ").otherwise(""), "p_name").alias("ti"))
    c = A.top_values(p, ["p_size"], "k", 3, "kw").join(A.top_values(p, ["p_size"], "s", 3, "sk"), "p_size").join(A.top_values(p, ["p_size"], "ti", 3, "tl"), "p_size")
    c = c.withColumn("bucket", F.when(s % 4 == 0, "new").when(s % 4 == 1, "other").otherwise("plain"))
    named = Y.cluster_names(c, "p_size", "bucket", "kw", "sk", "tl", {"Smith": ["anvil"], "Engineer": ["gear"]}, {"Stoker": ["hot"]}, ["bolt", "rod"])
    good = Y.good_clusters(named, "bucket", "kw", "sk", "tl", ["cold plate"], ["red", "small", "old"], {"new": 2, "other": 3}, ["ring"])
    return good.select("p_size", "bucket", "name")


@R.add("p09_topological_order", f"""WITH RECURSIVE e AS {EDGES_SQL}, l AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS level UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.dst = l.node), m AS (SELECT node, max(level) AS depth FROM l GROUP BY 1)
    SELECT node, row_number() OVER (ORDER BY depth, p_size % 5, p_size * 4, node) AS place FROM m JOIN part ON node = p_partkey""")
def p09(t: Tables) -> DataFrame:
    e = edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    n = t("part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 5).alias("level_of"), (F.col("p_size") * 4).alias("hours"))
    return G.topological_order(e, n, ["level_of", "hours"])


@R.add("p12_best_similarity", """SELECT a.vec_id, round(coalesce(max((list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) / 2), 0.45), 6) AS best FROM embeddings a LEFT JOIN embeddings b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1""")
def p12(t: Tables) -> DataFrame:
    e = t("embeddings")
    targets = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("target"), F.col("embedding").alias("te"))
    best = V.best_similarity(e, "vec_id", "embedding", targets, "target", "te")
    return e.select("vec_id").join(best, "vec_id", "left").select("vec_id", F.round(F.coalesce((F.col("best") + 1) / 2, F.lit(0.45)), 6).alias("best"))


@R.add("p16_career_ranking", """WITH r AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 10),
    l AS (SELECT p_partkey % 500 AS v, avg((p_size > 25)::INT) AS cov, avg(p_size) / 50 AS res, count(DISTINCT p_type) / 6 AS gr, avg((p_size <= 25)::INT) AS miss, avg(p_size % 5) / 5 AS pre, sum(p_size) AS hours FROM part GROUP BY 1),
    q AS (SELECT query_id, vec_id, round(greatest(0, least(1, 0.42 * (s + 1) / 2 + 0.23 * cov + 0.10 * res + 0.08 * gr - 0.19 * miss - 0.15 * pre - 0.09 * least(1, hours / 320))), 3) AS score FROM r JOIN l ON v = vec_id % 500) SELECT query_id, vec_id, score FROM q""")
def p16(t: Tables) -> DataFrame:
    """Coverage, resources, graph, gap, prerequisites and hours of a role from the parts of its number."""
    e, s = t("embeddings"), F.col("p_size")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    near = V.cosine_top(e, "vec_id", "embedding", q, "query_id", "qe", 10).withColumn("v", F.col("vec_id") % 500)
    inputs = t("part").groupBy((F.col("p_partkey") % 500).alias("v")).agg(
        F.avg((s > 25).cast("double")).alias("cov"), (F.avg(s) / 50).alias("res"), (F.count_distinct("p_type") / 6).alias("gr"),
        F.avg((s <= 25).cast("double")).alias("miss"), (F.avg(s % 5) / 5).alias("pre"), F.sum(s).alias("hours"),
    )
    total = C.role_total((F.col("score") + 1) / 2, *[F.col(c) for c in ("cov", "res", "gr", "miss", "pre", "hours")], digits=3)
    return near.join(inputs, "v").select("query_id", "vec_id", total.alias("score")).orderBy("query_id", F.col("score").desc(), "vec_id")
