"""Scores, gates and assembled rows over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators import graphs as G
from harborline.operators import relational as O
from harborline.operators import roles as X
from harborline.operators import scoring as C
from harborline.operators import series as S
from harborline.operators import taxonomy as Y
from harborline.operators.matching import tokens
from harborline.plans.registry import Registry, Tables
from harborline.plans.retrieval import EDGES_SQL, edges, nodes, skills

R = Registry()
KEYWORDS = ["the", "que", "die", "idiot", "les"]


@R.add("m15_keyword_filter", """WITH h AS (SELECT doc_id, list_filter(['the','que','die','idiot','les'], lambda x: list_contains(regexp_extract_all(lower(text), '[a-z0-9+#]+'), x)) AS hits FROM documents) SELECT doc_id, hits FROM h WHERE len(hits) >= 2""")
def m15(t: Tables) -> DataFrame:
    return C.keyword_filter(t("documents"), "text", KEYWORDS, 2).select("doc_id", "hits")


@R.add("m20_roles_with_fallback", """WITH r AS (SELECT DISTINCT p_type AS bucket, p_brand AS role, split_part(p_name, ' ', 2) AS term FROM part), d AS (SELECT p_partkey, p_type AS bucket, CASE WHEN p_partkey % 5 = 0 THEN ['none'] ELSE string_split(p_name, ' ') END AS w FROM part),
    h AS (SELECT DISTINCT p_partkey, role FROM d JOIN r ON d.bucket = r.bucket AND list_contains(w, term)), f AS (SELECT bucket, role, row_number() OVER (PARTITION BY bucket ORDER BY role) AS k FROM (SELECT DISTINCT bucket, role FROM r))
    SELECT p_partkey, role, true AS matched FROM h UNION ALL SELECT p_partkey, role, false FROM d JOIN f USING (bucket) WHERE k <= 5 AND p_partkey NOT IN (SELECT p_partkey FROM h)""")
def m20(t: Tables) -> DataFrame:
    roles = t("part").select(F.col("p_type").alias("bucket"), F.col("p_brand").alias("role"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term")).distinct()
    docs = t("part").select("p_partkey", F.col("p_type").alias("bucket"), F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.col("p_name")).alias("x"))
    return C.roles_with_fallback(docs, "p_partkey", "bucket", "x", roles, 5)


@R.add("m22_relevance_gate", "SELECT event_id FROM events WHERE user_id % 10 <> 0 AND value > 2 AND (event_type = 'purchase' OR (event_type = 'click' AND value > 20))")
def m22(t: Tables) -> DataFrame:
    k, v = F.col("event_type"), F.col("value")
    return t("events").where(C.relevant(F.col("user_id") % 10 == 0, v > 2, k == "purchase", k == "click", v > 20)).select("event_id")


@R.add("m36_generated_aliases", """WITH a AS (SELECT p_partkey, list_filter([p_name, CASE WHEN split_part(p_name, ' ', 2) IN ('ring','gear') THEN split_part(p_name, ' ', 1) ELSE p_name END, replace(p_name, 'red', 'crimson'), lower(p_brand)], lambda x: x <> '') AS l FROM part)
    SELECT p_partkey, list_sort(list_distinct(l)) AS aliases FROM a""")
def m36(t: Tables) -> DataFrame:
    stored = F.array("p_brand", F.upper("p_name"))
    return t("part").select("p_partkey", F.array_sort(C.generated_aliases(F.col("p_name"), ["ring", "gear"], {"red": "crimson"}, stored)).alias("aliases"))


@R.add("m38_events_by_keywords", """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#]+')) AS w FROM documents), e AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#]+')) AS k FROM benchmark),
    h AS (SELECT item_id, doc_id, len(list_intersect(w, k)) AS hits FROM d, e WHERE len(list_intersect(w, k)) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM h) SELECT item_id, doc_id, hits, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def m38(t: Tables) -> DataFrame:
    words = t("benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("keyword"))
    found = X.events_by_keywords(t("documents").select("doc_id", "text"), "doc_id", "text", words, "item_id", "keyword", 2, [F.col("hits").desc(), F.col("doc_id")], 3)
    return found.select("item_id", "doc_id", "hits", "rank")


@R.add("g10_term_budget", """WITH e AS (SELECT p_partkey, unnest([p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)]) AS term, unnest([0, 1, 2, 3]) AS p FROM part), w AS (SELECT *, CASE WHEN p = 0 THEN 0.15 ELSE 0.7 / p / (1 + 1/2.0 + 1/3.0) END AS w FROM e)
    SELECT p_partkey, term, round(arg_max(w, p), 6) AS weight FROM w GROUP BY 1, 2""")
def g10(t: Tables) -> DataFrame:
    items = F.concat(F.array("p_brand"), F.split("p_name", " "), F.array(F.lower("p_type")))
    return C.term_budget(t("part").select("p_partkey", items.alias("items")), "p_partkey", "items", 0.15, 0.7).select("p_partkey", "term", F.round("weight", 6).alias("weight"))


@R.add("g20_alias_coverage", """SELECT term, count(DISTINCT role) AS roles, term = 'anvil' OR count(DISTINCT role) >= 30 OR (count(DISTINCT role) >= 20 AND (contains(term, 'i') OR length(term) <= 4)) AS common FROM (SELECT p_brand || p_type AS role, unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY 1""")
def g20(t: Tables) -> DataFrame:
    each = t("part").select(F.concat("p_brand", "p_type").alias("role"), F.explode(F.split(F.upper("p_name"), " ")).alias("term"))
    return Y.alias_coverage(each, "term", "role", ["anvil"], ["i"])


@R.add("g29_merge_lineage", """WITH r AS (SELECT p_size AS id, 'c' || p_size AS name, count(*) AS size FROM part GROUP BY 1), d AS (SELECT n_nationkey + 1 AS id, CASE WHEN n_nationkey % 4 > 0 THEN 'f' || (n_nationkey % 3) END AS final, n_nationkey % 10 / 10.0 AS confidence, n_name AS note, CASE WHEN n_nationkey % 4 = 0 THEN 'noise' END AS reason FROM nation), t AS (SELECT * FROM r LEFT JOIN d USING (id))
    SELECT 'merged' AS kind, final AS name, CAST(sum(size) AS BIGINT) AS n, string_agg(id || ':' || name || ':' || size || ':' || note, ',' ORDER BY id) AS detail FROM t WHERE final IS NOT NULL GROUP BY final UNION ALL SELECT 'dropped', name, size, coalesce(reason, 'undecided') FROM t WHERE final IS NULL
    UNION ALL SELECT 'summary', NULL, count(*), count(DISTINCT final) || ',' || count(*) FILTER (final IS NULL) || ',' || CAST(sum(size) FILTER (final IS NOT NULL) AS BIGINT) || ',' || CAST(sum(size) FILTER (final IS NULL) AS BIGINT) FROM t""")
def g29(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    roles = t("part").groupBy(F.col("p_size").alias("id")).agg(F.count("*").alias("size")).withColumn("name", F.concat(F.lit("c"), "id"))
    decided = t("nation").select((k + 1).alias("id"), F.when(k % 4 > 0, F.concat(F.lit("f"), k % 3)).alias("final"), (k % 10 / 10.0).alias("confidence"), F.col("n_name").alias("note"), F.when(k % 4 == 0, "noise").alias("reason"))
    merged, dropped, summary = Y.merge_lineage(roles, "id", "name", "size", decided)
    spelled = F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["id"].cast("string"), x["name"], x["size"].cast("string"), x["note"])), ",")
    rows = merged.select(F.lit("merged").alias("kind"), F.col("final").alias("name"), F.col("size").alias("n"), spelled.alias("detail"))
    rows = rows.unionByName(dropped.select(F.lit("dropped").alias("kind"), "name", F.col("size").alias("n"), F.col("reason").alias("detail")))
    totals = F.concat_ws(",", *[F.col(c).cast("string") for c in ("after", "dropped", "kept_size", "dropped_size")])
    return rows.unionByName(summary.select(F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("before").alias("n"), totals.alias("detail")))


@R.add("r09_first_available", """WITH a AS (SELECT c_nationkey, c_custkey, 0 AS tier FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer WHERE c_acctbal > 8000) SELECT c_nationkey, c_custkey FROM a WHERE tier = (SELECT min(tier) FROM a b WHERE b.c_nationkey = a.c_nationkey)""")
def r09(t: Tables) -> DataFrame:
    c = t("customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return C.first_available([c.where("c_acctbal > 9500"), c.where("c_acctbal > 8000")], ["c_nationkey"]).drop("c_acctbal")


@R.add("r15_jaccard", """WITH l AS (SELECT DISTINCT o_custkey, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), r AS (SELECT DISTINCT p_brand, p_name FROM part), z AS (SELECT p_brand, count(*) AS size FROM r GROUP BY 1), b AS (SELECT o_custkey, p_brand, count(*) AS overlap FROM l JOIN r USING (p_name) GROUP BY 1, 2),
    g AS (SELECT o_custkey, CASE o_custkey % 20 WHEN 0 THEN 'brand#2' WHEN 10 THEN 'and#1' END AS target FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 10 = 0), a AS (SELECT o_custkey, p_brand FROM g JOIN z ON contains(lower(p_brand), target) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY lower(p_brand) <> target, p_brand) = 1)
    SELECT o_custkey, p_brand, overlap, round(overlap / size, 6) AS share FROM b JOIN z USING (p_brand) WHERE o_custkey NOT IN (SELECT o_custkey FROM a) UNION ALL SELECT a.o_custkey, a.p_brand, coalesce(overlap, 0), round(coalesce(overlap, 0) / size, 6) FROM a JOIN z USING (p_brand) LEFT JOIN b ON b.o_custkey = a.o_custkey AND b.p_brand = a.p_brand""")
def r15(t: Tables) -> DataFrame:
    """Customers by the names of what they ordered against brands; every tenth aims at a brand."""
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "p_name")
    k = F.col("o_custkey")
    targets = t("orders").where(k % 10 == 0).select("o_custkey").distinct().withColumn("target", F.when(k % 20 == 0, "brand#2").otherwise("and#1"))
    return C.jaccard_matches(bought, "o_custkey", t("part"), "p_brand", "p_name", targets)


@R.add("r19_token_accuracy", """WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark), p AS (SELECT CASE length(w) % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'X' ELSE 'O' END AS g, CASE WHEN length(w) % 3 = 0 THEN 'B' ELSE 'O' END AS f FROM w)
    SELECT count(*) AS n, round(avg((g = f)::INT), 6) AS accuracy, round(avg(CASE WHEN g <> 'O' THEN (g = f)::INT END), 6) AS labelled FROM p WHERE g <> 'X'""")
def r19(t: Tables) -> DataFrame:
    w = F.split("text", " ", -1)
    g = F.transform(w, lambda x: F.when(F.length(x) % 4 == 0, "B").when(F.length(x) % 4 == 1, "X").otherwise("O"))
    f = F.transform(w, lambda x: F.when(F.length(x) % 3 == 0, "B").otherwise("O"))
    return C.token_accuracy(t("benchmark").select(g.alias("gold"), f.alias("found")), "gold", "found", "O", "X")


@R.add("r24_compact_rows", """WITH k AS (SELECT o_custkey, l_partkey, min(o_orderdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), s AS (SELECT o_custkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY d, l_partkey) AS r FROM k), o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
    x AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, l_suppkey) AS r FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)), y AS (SELECT l_orderkey, string_agg(l_suppkey, '+' ORDER BY r) AS res FROM x WHERE r <= 2 GROUP BY 1),
    a AS (SELECT o_custkey, list(l_partkey ORDER BY r) AS skills FROM s WHERE r <= 12 GROUP BY 1), b AS (SELECT o_custkey, list(o_orderkey || ':' || coalesce(res, '') ORDER BY r) AS steps FROM o LEFT JOIN y ON l_orderkey = o_orderkey WHERE r <= 8 GROUP BY 1) SELECT o_custkey, skills, steps FROM b LEFT JOIN a USING (o_custkey)""")
def r24(t: Tables) -> DataFrame:
    o, l = t("orders"), t("lineitem")
    skills = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", F.col("l_partkey").alias("skill")).agg(F.min("o_orderdate").alias("place"))
    steps = o.select("o_custkey", F.col("o_orderdate").alias("place"), F.col("o_orderkey").alias("step"))
    resources = l.groupBy(F.col("l_orderkey").alias("step"), F.col("l_suppkey").alias("resource")).agg(F.min("l_linenumber").alias("place"))
    rows = C.compact_rows(o, "o_custkey", skills, steps, resources)
    spelled = F.transform("steps", lambda s: F.concat(s["step"].cast("string"), F.lit(":"), F.array_join(F.transform(s["resources"], lambda r: r.cast("string")), "+")))
    return rows.select("o_custkey", "skills", spelled.alias("steps"))


@R.add("p03_running_cost", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, round(0.55 * l_discount + 0.25 * CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.6 END + 0.2 / row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice), 6) AS quality FROM lineitem""")
def p03(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")]
    q = C.running_coverage_cost(t("lineitem"), "l_partkey", order, F.col("l_discount"), F.col("l_returnflag") == "A")
    return q.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "quality")


@R.add("p10_role_total", """SELECT p_partkey, round(greatest(0, least(1, 0.42 * (p_size / 50.0) + 0.23 * (p_partkey % 4 / 4.0) + 0.10 * 0.5 + 0.08 * 0.25 - 0.19 * (p_partkey % 3 / 3.0) - 0.15 * 0.1 - 0.09 * least(1, p_retailprice / 320))) + 1e-9, 4) AS score FROM part""")
def p10(t: Tables) -> DataFrame:
    k, half = F.col("p_partkey"), F.lit(0.5)
    raw = C.role_total(F.col("p_size") / 50.0, k % 4 / 4.0, half, F.lit(0.25), k % 3 / 3.0, F.lit(0.1), F.col("p_retailprice"))
    return t("part").select("p_partkey", raw.alias("score"))


@R.add("p10_path_analysis", """WITH a AS (SELECT n_nationkey AS u, r.p_brand AS role, n_nationkey % 4 / 4.0 AS sem FROM nation, (SELECT DISTINCT p_brand FROM part) r WHERE (n_nationkey + length(p_brand)) % 3 > 0), g AS (SELECT p_brand AS role, p_partkey AS skill, p_size / 50.0 AS w FROM part), k AS (SELECT DISTINCT s_nationkey AS u, l_partkey AS skill FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    x AS (SELECT a.u, a.role, sem, g.skill, w, k.skill IS NULL AS lacks, 0.45 * (p_partkey % 3 + 1) / 3.0 + 0.35 * (p_size % 5 + 1) / 5.0 + 0.2 * least(greatest(CASE WHEN g.skill % 4 = 0 THEN g.skill % 8 ELSE 1 END, 1) / 6.0, 1) AS hard, CASE WHEN g.skill % 5 > 0 THEN g.skill % 7 / 7.0 ELSE 0 END AS te, CASE WHEN g.skill % 6 > 0 THEN g.skill % 9 / 9.0 ELSE 0.45 END AS gr
      FROM a JOIN g USING (role) LEFT JOIN k ON k.u = a.u AND k.skill = g.skill JOIN part ON p_partkey = g.skill),
    s AS (SELECT u, role, any_value(sem) AS sem, sum(CASE WHEN lacks THEN 0 ELSE w END) / sum(w) AS cov, sum(CASE WHEN lacks THEN w ELSE 0 END) / sum(w) AS miss, sum(CASE WHEN lacks THEN w * least(1, hard) ELSE 0 END) / sum(w) AS pre, sum(CASE WHEN lacks THEN w * te ELSE 0 END) / sum(w) AS res, CASE WHEN bool_or(lacks) THEN sum(CASE WHEN lacks THEN w * gr ELSE 0 END) / sum(w) ELSE 1.0 END AS gr, CAST(u * 20 AS BIGINT) AS hours FROM x GROUP BY u, role)
    SELECT u, role, round(cov, 6) AS coverage, round(miss, 6) AS missing, round(pre, 6) AS prerequisite, round(res, 6) AS resource, round(gr, 6) AS graph, hours, round(greatest(0, least(1, 0.42 * sem + 0.23 * cov + 0.10 * res + 0.08 * gr - 0.19 * miss - 0.15 * pre - 0.09 * least(1, hours / 320))), 4) AS role_score, round(greatest(0, least(1, 0.45 * cov + 0.30 * res + 0.25 * gr - 0.20 * pre - 0.15 * least(1, hours / 320))), 4) AS path_score FROM s""")
def p10_path(t: Tables) -> DataFrame:
    """Nations as users that know the parts their suppliers deliver; brands as roles that want their parts."""
    part, k = t("part"), F.col("p_partkey")
    u = F.col("n_nationkey").alias("u")
    asked = t("nation").crossJoin(F.broadcast(part.select(F.col("p_brand").alias("role")).distinct())).where((F.col("n_nationkey") + F.length("role")) % 3 > 0)  # 25 brands
    asked = asked.select(u, "role", (F.col("n_nationkey") % 4 / 4.0).alias("semantic"))
    targets = part.select(F.col("p_brand").alias("role"), k.alias("skill"), (F.col("p_size") / 50.0).alias("importance"))
    known = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("u"), F.col("l_partkey").alias("skill"))
    skills = part.select(k.alias("skill"), (k % 3 + 1).cast("double").alias("difficulty"), (F.col("p_size") % 5 + 1).alias("level"), F.when(k % 5 > 0, k % 7 / 7.0).alias("teaches"), F.when(k % 6 > 0, k % 9 / 9.0).alias("graph"))
    depths = t("nation").select(u).crossJoin(part.where(k % 4 == 0).select(k.alias("skill"), (k % 8).alias("depth")))  # 25 nations
    hours = asked.where("u > 0").select("u", "role", (F.col("u") * 20).cast("long").alias("hours"))
    found = C.path_analysis(asked, "u", "role", targets, known, skills, depths, hours)
    return found.withColumn("hours", F.col("hours").cast("long"))


@R.add("p11_resource_quality", """SELECT l_partkey, round(avg(q), 6) AS quality FROM (SELECT l_partkey, l_discount AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_discount) AS k FROM lineitem) WHERE k <= 3 GROUP BY 1""")
def p11(t: Tables) -> DataFrame:
    first = O.top_per_key(t("lineitem"), ["l_partkey"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_discount")], 3)
    return first.groupBy("l_partkey").agg(F.round(F.avg("l_discount"), 6).alias("quality"))


@R.add("p14_non_edges", f"""WITH e AS {EDGES_SQL}, n AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS c FROM part), d AS (SELECT src, dst AS o, i, ('0x' || substr(md5(src || '-' || dst || '-' || i), 1, 15))::BIGINT % (SELECT any_value(c) FROM n) AS k FROM e, (SELECT unnest([1, 2, 3, 4]) AS i)),
    g AS (SELECT src, o, i, node AS dst FROM d JOIN n USING (k) WHERE src <> node AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = d.src AND e.dst = n.node)) SELECT DISTINCT src, dst FROM (SELECT src, arg_min(dst, i) AS dst FROM g GROUP BY src, o)""")
def p14(t: Tables) -> DataFrame:
    return G.non_edges(edges(t), nodes(t))


@R.add("p17_ordered_path", """WITH g AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey)[1:10] AS m FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, unnest(m) AS skill, generate_subscripts(m, 1) AS step FROM g), x AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS r FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)), y AS (SELECT l_partkey, list(l_suppkey ORDER BY r) AS resources FROM x WHERE r <= 2 GROUP BY 1)
    SELECT l_orderkey, CAST(step AS INTEGER) AS step, skill, CASE WHEN skill = 0 THEN 'core' WHEN skill // 2 = skill // 3 THEN (skill // 2) || ' > ' || (skill + 1000000) || ' > ' || skill ELSE (skill // 2) || ' > ' || (skill // 3) || ' > ' || skill END AS reason, CASE WHEN p_size % 10 = 0 THEN 20 ELSE p_size * 4 END AS hours, resources FROM s JOIN part ON p_partkey = skill LEFT JOIN y ON l_partkey = skill""")
def p17(t: Tables) -> DataFrame:
    """Orders as profiles that lack the parts they hold."""
    gaps = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("missing"))
    s = skills(t).withColumn("hours", F.when(F.col("hours") % 40 > 0, F.col("hours")))
    resources = t("lineitem").select(F.col("l_partkey").alias("skill"), F.col("l_suppkey").alias("resource"), F.col("l_suppkey").alias("place")).distinct()
    return G.ordered_path(gaps, "l_orderkey", "missing", s, resources)


@R.add("p19_ego_subgraph", """WITH RECURSIVE t AS (SELECT p_type AS role, p_partkey AS skill FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) <= 3), b AS (SELECT p_partkey AS dst, unnest(list_distinct([p_partkey // 2, p_partkey // 3])) AS src FROM part WHERE p_partkey > 0), c AS (SELECT role, skill AS node, 0 AS d FROM t UNION SELECT role, b.src, d + 1 FROM c JOIN b ON b.dst = c.node WHERE d < 2),
    x AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS r FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)), s AS (SELECT DISTINCT role, node FROM c), h AS (SELECT role, node, l_suppkey FROM s JOIN x ON l_partkey = node WHERE r <= 2),
    e AS (SELECT role, role AS src, CAST(skill AS VARCHAR) AS dst, 'needs' AS relation FROM t UNION SELECT role, CAST(b.src AS VARCHAR), CAST(b.dst AS VARCHAR), 'before' FROM c JOIN b ON b.dst = c.node WHERE d < 2 UNION SELECT role, CAST(node AS VARCHAR), CAST(l_suppkey AS VARCHAR), 'taught by' FROM h)
    SELECT role, 'edge' AS what, src AS a, dst AS b, relation AS kind FROM e UNION ALL SELECT role, 'node', CAST(node AS VARCHAR), NULL, 'skill' FROM s UNION ALL SELECT DISTINCT role, 'node', CAST(l_suppkey AS VARCHAR), NULL, 'resource' FROM h UNION ALL SELECT DISTINCT role, 'node', role, NULL, 'role' FROM t""")
def p19(t: Tables) -> DataFrame:
    """Part types as roles, with their largest parts as skills."""
    needs = t("part").select(F.col("p_type").alias("role"), F.col("p_partkey").alias("skill"), F.col("p_size").alias("weight"))
    before = edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    resources = t("lineitem").select(F.col("l_partkey").alias("skill"), F.col("l_suppkey").alias("resource"), F.col("l_suppkey").alias("place")).distinct()
    found, lines = G.ego_subgraphs(needs.select("role").distinct(), needs, before, resources, 3, 2, 2)
    rows = found.select("role", F.lit("node").alias("what"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "kind")
    return rows.unionByName(lines.select("role", F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("kind")))


@R.add("s01_global_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def s01(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey")


@R.add("s04_union", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def s04(t: Tables) -> DataFrame:
    return t("nation").select(F.col("n_name").alias("name")).unionByName(t("region").select(F.col("r_name").alias("name")))
