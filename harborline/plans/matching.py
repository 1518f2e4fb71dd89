"""Term, name and role matching over parts, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators import matching as M
from harborline.operators import relational as O
from harborline.operators import roles as X
from harborline.plans.registry import Registry, Tables

R = Registry()
#: Fixed values for these plans.
RULES = {"metal": ["bolt", "ring"], "machine": ["gear", "widget"], "colour": ["red", "blue"]}
HINTS = ["red", "ol"]


@R.add("m01_bounded_term", """SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])than($|[^a-z0-9])') AS hit FROM documents""")
def m01(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", M.bounded_term(F.col("text"), "than").alias("hit"))


@R.add("m02_hit_fraction", r"""WITH k AS (SELECT ['the', 'que', ' is the', 'de la ', 'c++', 'a', '', 'of', 'idiot.', 'license'] AS k), u AS (SELECT list_filter(list_transform(k, lambda s: trim(s)), lambda s: s <> '' AND s <> 'of' AND (length(s) >= 3 OR s IN ('c++', 'c#', '.net', 'aws', 'sql'))) AS u FROM k),
    h AS (SELECT doc_id, list_filter(u, lambda s: regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(s) || '($|[^a-z0-9])')) AS hit, len(u) AS n FROM documents, u) SELECT doc_id, hit, round(len(hit) / n, 6) AS share FROM h""")
def m02(t: Tables) -> DataFrame:
    skills = X.array_of(["the", "que", " is the", "de la ", "c++", "a", "", "of", "idiot.", "license"])
    found = t("documents").select("doc_id", M.skill_hits(F.col("text"), skills, ["of"]).alias("h"))
    return found.select("doc_id", F.col("h.hits").alias("hit"), "h.share")


@R.add("m03_dictionary_matches", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9+#]+') AS w FROM documents), a AS (SELECT * FROM (VALUES ('the', 'T'), ('is the', 'IT'), ('and', 'A'), ('que', 'Q'), ('de la', 'DL'), ('la', 'L')) v(alias, name)),
    p AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM w), g AS (SELECT doc_id, 1 AS n, pos, w[pos + 1] AS gram FROM p UNION ALL SELECT doc_id, 2, pos, w[pos + 1] || ' ' || w[pos + 2] FROM p WHERE pos + 2 <= len(w)),
    f AS (SELECT doc_id, pos, n, name FROM g JOIN a ON gram = alias), k AS (SELECT f.* FROM f LEFT JOIN f o ON o.doc_id = f.doc_id AND o.n = 2 AND f.n = 1 AND o.pos IN (f.pos, f.pos - 1) WHERE o.n IS NULL),
    m AS (SELECT doc_id, name, min(pos) AS pos FROM k GROUP BY 1, 2) SELECT doc_id, list(name ORDER BY pos, name)[1:4] AS names FROM m GROUP BY 1""")
def m03(t: Tables) -> DataFrame:
    docs = t("documents")
    pairs = [("the", "T"), ("is the", "IT"), ("and", "A"), ("que", "Q"), ("de la", "DL"), ("la", "L")]
    aliases = docs.sparkSession.createDataFrame(pairs, "alias string, name string")
    return M.dictionary_matches(docs, "doc_id", "text", aliases, 2, 4)


@R.add("m04_frequent_terms", "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE length(term) >= 4 GROUP BY 1 HAVING count(*) >= 100")
def m04(t: Tables) -> DataFrame:
    return M.frequent_terms(t("part"), F.split("p_name", " "), 100, 4)


#: Fixed values of the role plans: name, aliases, skills, whether generic.
ROLE_ROWS = [
    ("red gear", ["crimson cog", "hot gear"], ["promo", "small", "work", "of"], False),
    ("bolt engineer", ["fastener"], ["economy", "zinc", "medium"], True),
    ("small blue anvil", ["forge"], ["medium", "large", "anvil", "work"], False),
    ("plate gizmo rod lead", ["old rod"], ["promo", "economy", "plate", "brass"], False),
    ("widget", ["forge"], ["tin", "lead"], True),
    ("node.js smith", ["c++", "iron.io hand"], ["of", "to", "s1", "s2", "s3", "s4", "s5", "s6", "polished", "burnished", "none", "worker"], False),
]
ROLES_SQL = """(SELECT *, list_filter(regexp_extract_all(role, '[a-z0-9+#.]+'), lambda w: w NOT IN ('engineer', 'lead')) AS rw, list_filter(skills[1:10], lambda s: length(s) >= 3) AS sk, regexp_extract_all(array_to_string(aliases, ' '), '[a-z0-9+#.]+') AS aw FROM (VALUES
    ('red gear', ['crimson cog', 'hot gear'], ['promo', 'small', 'work', 'of'], false), ('bolt engineer', ['fastener'], ['economy', 'zinc', 'medium'], true), ('small blue anvil', ['forge'], ['medium', 'large', 'anvil', 'work'], false),
    ('plate gizmo rod lead', ['old rod'], ['promo', 'economy', 'plate', 'brass'], false), ('widget', ['forge'], ['tin', 'lead'], true),
    ('node.js smith', ['c++', 'iron.io hand'], ['of', 'to', 's1', 's2', 's3', 's4', 's5', 's6', 'polished', 'burnished', 'none', 'worker'], false)) v(role, aliases, skills, generic))"""
POSTINGS_SQL = """(SELECT p_partkey, title, body, CASE WHEN p_partkey % 11 > 0 THEN '2020-01-01' END AS month, list_filter(regexp_extract_all(title, '[a-z0-9+#.]+'), lambda w: w NOT IN ('senior', 'engineer', 'lead')) AS pw FROM
    (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'senior ' || p_name WHEN 1 THEN p_name || ' (forge)' WHEN 2 THEN split_part(p_name, ' ', 2) || ' lead' WHEN 3 THEN lower(p_type) || ' worker' WHEN 4 THEN 'node.js ' || p_name WHEN 5 THEN 'js dev, ' || lower(p_type)
      WHEN 6 THEN 'crimson cap' WHEN 7 THEN 'iron.io, c++' ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) || ', work' ELSE 'none' END AS body FROM part))"""
STANDS = "regexp_matches({}, '(^|[^a-z0-9])' || regexp_escape(s) || '($|[^a-z0-9])')"
CANDIDATES_SQL = f"""p AS {POSTINGS_SQL}, r AS {ROLES_SQL}, h AS (SELECT p_partkey, role FROM p, r WHERE len(list_intersect(pw, list_concat(rw, aw))) > 0 OR contains(title, role) OR len(list_filter(aliases, lambda s: {STANDS.format('title')})) > 0),
    c AS (SELECT * FROM h UNION ALL SELECT p_partkey, role FROM p, r WHERE p_partkey NOT IN (SELECT p_partkey FROM h))"""
MATCH_SQL = f"""{CANDIDATES_SQL}, x AS (SELECT p_partkey, role, title, body, month, generic, len(list_distinct(list_intersect(pw, rw))) AS sh, len(list_distinct(rw)) AS sz, len(list_filter(aliases, lambda s: {STANDS.format('title')})) > 0 AS al,
      list_filter(sk, lambda s: {STANDS.format('title || chr(10) || body')}) AS held, list_filter(sk, lambda s: {STANDS.format('title')}) AS named, len(sk) AS n FROM c JOIN p USING (p_partkey) JOIN r USING (role)),
    y AS (SELECT *, CASE WHEN contains(title, role) THEN 1.0 WHEN sz >= 2 AND sh >= 2 AND sh / sz >= 0.5 THEN round(0.55 + 0.35 * sh / sz, 6) WHEN sz = 1 AND sh = 1 THEN 0.65 ELSE 0.0 END AS ti, len(held) AS h, len(named) AS t, round(len(held) / n, 6) AS hf, round(len(named) / n, 6) AS tf FROM x),
    z AS (SELECT *, ti > 0 OR al AS ok, greatest(ti, CASE WHEN al THEN 0.92 ELSE 0 END) AS base, t >= 2 OR tf >= 0.2 AS strong FROM y),
    u AS (SELECT *, NOT ok AND ((strong AND h >= 2 AND hf >= 0.2) OR (t >= 1 AND tf >= 0.1 AND h >= 3 AND hf >= 0.35)) AS alone FROM z),
    v AS (SELECT *, CASE WHEN alone THEN least(0.78, 0.2 + 0.58 * hf) + CASE WHEN strong THEN 0.08 ELSE 0.04 END WHEN ok AND h > 0 THEN greatest(base, least(1.2, base + 0.15 + 0.35 * hf)) ELSE base END AS s,
      CASE WHEN alone THEN 'skill' WHEN ok AND (h > 0 OR (ti > 0 AND al)) THEN 'mixed' WHEN al THEN 'alias' WHEN ti > 0 THEN 'title' ELSE 'none' END AS b FROM u),
    final AS (SELECT p_partkey, role, month, held, CAST(CASE WHEN bad THEN 0 ELSE s END AS DOUBLE) AS score, CASE WHEN bad THEN 'none' ELSE b END AS how FROM (SELECT *, generic AND ((b IN ('title', 'alias') AND h = 0 AND NOT contains(title || chr(10) || body, 'large')) OR (b = 'skill' AND sh = 0)) AS bad FROM v))"""


def roles(t: Tables) -> DataFrame:
    return t("part").sparkSession.createDataFrame(ROLE_ROWS, "role string, aliases array<string>, skills array<string>, generic boolean")


def postings(t: Tables) -> DataFrame:
    s, name, kind = F.col("p_size") % 9, F.col("p_name"), F.lower("p_type")
    title = (
        F.when(s == 0, F.concat(F.lit("senior "), name)).when(s == 1, F.concat(name, F.lit(" (forge)"))).when(s == 2, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" lead")))
        .when(s == 3, F.concat(kind, F.lit(" worker"))).when(s == 4, F.concat(F.lit("node.js "), name)).when(s == 5, F.concat(F.lit("js dev, "), kind))
        .when(s == 6, "crimson cap").when(s == 7, "iron.io, c++").otherwise(name)
    )
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(kind, F.lit(", work"))).otherwise("none")
    return t("part").select("p_partkey", title.alias("title"), body.alias("body"), F.when(F.col("p_partkey") % 11 > 0, "2020-01-01").alias("month"))


def scored(t: Tables) -> DataFrame:
    return X.scored_roles(postings(t), "p_partkey", "title", "body", roles(t), "role", "aliases", "skills", "generic", support=["large"])


@R.add("m08_role_candidates", f"WITH {CANDIDATES_SQL} SELECT p_partkey, role FROM c")
def m08(t: Tables) -> DataFrame:
    return X.role_candidates(postings(t), "p_partkey", "title", roles(t), "role", "aliases")


@R.add("m09_m10_best_role", f"""WITH {MATCH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, how = 'title' DESC, role) AS k FROM final WHERE score > 0)
    SELECT p_partkey, role, round(score, 6) AS score, how, held FROM k WHERE k = 1 AND score >= 0.45 AND (how <> 'skill' OR score >= 0.6) AND month IS NOT NULL""")
def m10(t: Tables) -> DataFrame:
    return X.matched_postings(postings(t), "p_partkey", "month", scored(t), "role").select("p_partkey", "role", "score", F.col("by").alias("how"), "held")


@R.add("m11_deduplicated", """SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name, p_type, p_brand ORDER BY p_size, p_partkey) AS k FROM part) WHERE k = 1""")
def m11(t: Tables) -> DataFrame:
    shouted = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.col("p_name"))
    return M.without_repeats(t("part"), [shouted, F.col("p_type"), F.col("p_brand")], [F.col("p_size"), F.col("p_partkey")]).select("p_partkey")


@R.add("m12_demand_weight", "SELECT o_orderkey, round(0.8 + 0.4 * least(o_orderkey % 13 / 10.0, 1.0) + least(o_totalprice / 500000, 0.2) + 1e-9, 6) AS weight FROM orders")
def m12(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.round(M.demand_weight(F.col("o_orderkey") % 13 / 10.0, F.col("o_totalprice")) + 1e-9, 6).alias("weight"))


@R.add("m13_loose_filter", f"""WITH r AS {ROLES_SQL}, w AS (SELECT DISTINCT lower(unnest(list_concat([role], list_concat(aliases[1:5], skills[1:6])))) AS term FROM r), p AS (SELECT p_partkey, title || ' ' || body AS x FROM {POSTINGS_SQL})
    SELECT p_partkey FROM p WHERE contains(x, 'cold')::INT + contains(x, 'none')::INT + contains(x, 'ring')::INT >= 2 OR EXISTS (SELECT 1 FROM w WHERE contains(x, term))""")
def m13(t: Tables) -> DataFrame:
    rows = postings(t).withColumn("x", F.concat_ws(" ", "title", "body"))
    return X.loosely_related(rows, "x", roles(t), "role", "aliases", "skills", ["cold", "none", "ring"]).select("p_partkey")


RULES_SQL = """list_filter([CASE WHEN contains(p_name,'bolt') OR contains(p_name,'ring') THEN 'metal' END, CASE WHEN contains(p_name,'gear') OR contains(p_name,'widget') THEN 'machine' END,
    CASE WHEN contains(p_name,'red') OR contains(p_name,'blue') THEN 'colour' END], lambda x: x IS NOT NULL)"""


@R.add("m16_labels_by_rules", f"SELECT p_partkey, {RULES_SQL} AS labels FROM part")
def m16(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", M.labels_by_rules(F.col("p_name"), RULES).alias("labels"))


@R.add("m18_hint_share", """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) || '#' || p_size || '; ' || split_part(p_name, ' ', 2) || ';;' || p_type || '#RED' END AS x FROM part),
    n AS (SELECT p_partkey, list_transform(list_filter(string_split(coalesce(x, ''), ';'), lambda p: trim(p) <> ''), lambda p: upper(trim(split_part(p, '#', 1)))) AS n FROM t)
    SELECT p_partkey, round(len(list_filter(n, lambda p: contains(p, 'RED') OR contains(p, 'OL'))) / greatest(len(n), 1), 6) AS share, round(len(list_filter(n, lambda p: contains(p, 'ROMO'))) / greatest(len(n), 1), 6) AS other FROM n""")
def m18(t: Tables) -> DataFrame:
    themes = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("#"), F.col("p_size").cast("string"), F.lit("; "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(";;"), "p_type", F.lit("#RED"))
    found = t("part").select("p_partkey", M.theme_shares(F.when(F.col("p_partkey") % 9 > 0, themes), ["RED", "OL"], ["ROMO"]).alias("s"))
    return found.select("p_partkey", F.col("s.risk").alias("share"), F.col("s.opportunity").alias("other"))


@R.add("m19_fractional_attribution", """WITH d AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS x, unnest(list_filter([CASE WHEN contains(p_name,'bolt') OR contains(p_name,'ring') THEN 'metal' END, CASE WHEN contains(p_name,'gear') OR contains(p_name,'widget') THEN 'machine' END,
    CASE WHEN contains(p_name,'red') OR contains(p_name,'blue') THEN 'colour' END], lambda x: x IS NOT NULL)) AS bucket FROM part), t AS (SELECT DISTINCT CASE length(p_type) % 3 WHEN 0 THEN 'metal' WHEN 1 THEN 'machine' ELSE 'colour' END AS bucket, p_brand AS role, unnest([split_part(p_name, ' ', 2), lower(p_type), 'red']) AS term FROM part),
    h AS (SELECT p_partkey, d.bucket, role, count(*) AS n FROM d JOIN t ON d.bucket = t.bucket AND length(term) >= 4 AND contains(x, term) GROUP BY ALL) SELECT p_partkey, bucket, role, round(n / sum(n) OVER (PARTITION BY p_partkey, bucket), 6) AS weight FROM h""")
def m19(t: Tables) -> DataFrame:
    kind = F.length("p_type") % 3
    bucket = F.when(kind == 0, "metal").when(kind == 1, "machine").otherwise("colour").alias("bucket")
    terms = F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), "p_type", F.lit("red"))
    terms = t("part").select(bucket, F.col("p_brand").alias("role"), F.explode(terms).alias("term"))
    docs = t("part").select("p_partkey", M.labels_by_rules(F.col("p_name"), RULES).alias("buckets"), F.concat_ws(" ", "p_name", "p_type").alias("x"))
    found = X.substring_attribution(docs, "p_partkey", "buckets", "x", terms)
    return found.select("p_partkey", "bucket", "role", F.round("weight", 6).alias("weight"))


@R.add("m21_recent_query", """SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[1-3]-') AND o_orderdate > (SELECT max(o_orderdate) - INTERVAL 3 MONTH FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def m21(t: Tables) -> DataFrame:
    return M.recent_matches(t("orders"), "o_orderdate", "o_orderpriority", "^[1-3]-", 3, "o_orderkey", 50).select("o_orderkey")


@R.add("m24_first_rule", f"SELECT p_partkey, coalesce({RULES_SQL}[1], 'report') AS kind FROM part")
def m24(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", M.first_rule(F.col("p_name"), RULES, "report").alias("kind"))


@R.add("m25_polarity", "SELECT event_id, CASE WHEN value - 20 > 5 THEN 'positive' WHEN value - 20 < -5 THEN 'negative' WHEN event_type = 'error' THEN 'negative' WHEN event_type = 'purchase' THEN 'positive' ELSE 'neutral' END AS polarity FROM events")
def m25(t: Tables) -> DataFrame:
    p = M.polarity(F.col("value") - 20, 5, F.col("event_type"), {"error": "negative", "purchase": "positive"})
    return t("events").select("event_id", p.alias("polarity"))


@R.add("m26_majority", "SELECT user_id, CAST(sign(sum(sign(value - 20))) AS INTEGER) AS majority FROM events GROUP BY 1")
def m26(t: Tables) -> DataFrame:
    return M.majority(t("events").withColumn("s", F.signum(F.col("value") - 20)), "user_id", "s")


@R.add("m27_coarse_bucket", f"""WITH c AS (SELECT p_partkey, contains(p_name,'bolt')::INT + contains(p_name,'ring')::INT AS a, contains(p_name,'gear')::INT + contains(p_name,'widget')::INT AS b, contains(p_name,'red')::INT + contains(p_name,'blue')::INT AS c FROM part)
    SELECT p_partkey, CASE WHEN a + b + c = 0 THEN NULL WHEN a >= b AND a >= c THEN 'metal' WHEN b >= c THEN 'machine' ELSE 'colour' END AS bucket FROM c""")
def m27(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", M.coarse_bucket(F.col("p_name"), RULES).alias("bucket"))


@R.add("m28_field_extraction", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'doctor' WHEN 1 THEN 'master' WHEN 2 THEN 'bachelor' END AS education, CASE WHEN o_orderkey % 3 = 0 THEN greatest(o_orderkey % 20, 4) WHEN o_orderkey % 3 = 1 THEN o_orderkey % 20 END::INTEGER AS years,
    round(CASE o_orderkey % 2 WHEN 0 THEN (o_orderkey % 9 + 1) * 1000.0 ELSE (o_orderkey % 9 + 1) * 10000.0 / 12 END, 4) AS pay_low, round(CASE o_orderkey % 2 WHEN 0 THEN (o_orderkey % 9 + 3) * 1000.0 ELSE (o_orderkey % 9 + 3) * 10000.0 / 12 END, 4) AS pay_high,
    o_orderpriority AS labelled, CASE WHEN o_orderkey % 5 = 0 THEN 'Lyon' WHEN o_orderkey % 5 = 1 THEN 'Oslo' END AS city, CASE WHEN o_orderkey % 2 = 0 THEN 'clerk' END AS name, [CASE WHEN o_orderkey % 3 = 0 THEN 'Project: ' || o_orderkey || chr(10) || 'done' ELSE 'Project: a' END, 'Project: b'] AS projects FROM orders""")
def m28(t: Tables) -> DataFrame:
    """Fields of a text made of each order."""
    k = F.col("o_orderkey")
    lines = F.concat_ws(
        "\n",
        F.when(k % 4 == 0, "Bachelor of Arts, PhD").when(k % 4 == 1, "a Master's degree").when(k % 4 == 2, "undergraduate; B.Sc.").otherwise("school"),
        F.when(k % 3 == 0, F.concat((k % 20).cast("string"), F.lit("+ years, Experience: 4"))).when(k % 3 == 1, F.concat(F.lit("experience : "), k % 20)).otherwise("some years"),
        F.concat(F.lit("pay "), k % 9 + 1, F.lit(" - "), k % 9 + 3, F.when(k % 2 == 0, "K").otherwise("万")),
        F.concat(F.lit("Major:  "), F.col("o_orderpriority"), F.lit(" ")),
        F.when(k % 5 == 0, "Lyon or Oslo").when(k % 5 == 1, "in oslo, Lyon").otherwise("Rome"),
        F.when(k % 2 == 0, "a Clerk and driver").otherwise("none"),
        F.when(k % 3 == 0, F.concat(F.lit("Project: "), k, F.lit("\ndone"))).otherwise("Project: a"),
        F.lit("Project: b"),
    )
    levels = {"doctor": ["phd", "doctor"], "master": ["master"], "bachelor": ["bachelor", "b.sc"]}
    fields = M.fields_of_text(F.col("text"), levels, "major", ["Oslo", "Lyon"], ["clerk"], "Project:")
    fields["pay_low"], fields["pay_high"] = F.round(fields["pay_low"], 4), F.round(fields["pay_high"], 4)
    return t("orders").select("o_orderkey", lines.alias("text")).select("o_orderkey", *[c.alias(n) for n, c in fields.items()])


@R.add("m30_spans_of_tags", """WITH w AS (SELECT item_id, generate_subscripts(string_split(text, ' '), 1) AS p, unnest(string_split(text, ' ')) AS w FROM benchmark), t AS (SELECT *, CASE length(w) % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'I' WHEN 2 THEN 'I' ELSE 'O' END AS tag FROM w),
    s AS (SELECT *, sum((tag = 'B')::INT) OVER (PARTITION BY item_id ORDER BY p) AS span, sum((tag = 'O')::INT) OVER (PARTITION BY item_id ORDER BY p) AS gap FROM t), k AS (SELECT *, min(gap) OVER (PARTITION BY item_id, span) AS g FROM s WHERE tag <> 'O' AND span > 0)
    SELECT item_id, min(p) - 1 AS start, string_agg(w, ' ' ORDER BY p) AS phrase FROM k WHERE gap = g GROUP BY item_id, span""")
def m30(t: Tables) -> DataFrame:
    w = t("benchmark").select("item_id", F.posexplode(F.split("text", " ", -1)).alias("p", "w"))
    n = F.length("w") % 4
    tagged = w.withColumn("tag", F.when(n == 0, "B").when(n == 3, "O").otherwise("I"))
    spans = M.spans_of_tags(tagged, "item_id", "p", "tag", "w")
    return spans.select("item_id", F.col("start").cast("long").alias("start"), "phrase")


@R.add("m30_weak_labels", r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9+#.]+(?:[-/][A-Za-z0-9+#.]+)*|[^\s]') AS w FROM conversations), n AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9+#.]+', '', 'g')) AS n FROM w),
    k AS (SELECT * FROM (VALUES (0, ['the', 'first', 'part']), (1, ['first', 'part']), (2, ['what', 'is']), (3, ['the', 'the']), (4, ['part']), (5, ['the']), (6, ['is']), (7, ['of'])) v(r, k)),
    h AS (SELECT conv_id, turn, list([p, len(k)] ORDER BY r, p) AS h FROM (SELECT conv_id, turn, n, unnest(range(1, len(n) + 1)) AS p FROM n), k WHERE n[p : p + len(k) - 1] = k GROUP BY ALL),
    l AS (SELECT conv_id, turn, w, list_reduce(list_prepend(list_transform(w, lambda x: CAST(0 AS BIGINT)), h), lambda a, m: CASE WHEN a[m[1]] = 0 THEN list_transform(a, lambda y, i: CASE WHEN i = m[1] THEN 1 WHEN i > m[1] AND i < m[1] + m[2] THEN 2 ELSE y END) ELSE a END) AS l FROM n JOIN h USING (conv_id, turn))
    SELECT conv_id, turn, array_to_string(list_transform(l, lambda x: ['O', 'B', 'I'][x + 1]), '') AS labels, md5(array_to_string(w, ' ')) AS tokens FROM l""")
def m30_weak(t: Tables) -> DataFrame:
    """Nested and touching skills in turns; where none stands there is no row."""
    skills = X.array_of(["of", "is", "The", "part", "the the", "What is", "first part", "the first-part", "the first part", "", "??"])
    rows = t("conversations").select("conv_id", "turn", M.weak_labels(F.col("text"), skills).alias("l")).where("l.labels IS NOT NULL")
    return rows.select("conv_id", "turn", F.array_join("l.labels", "").alias("labels"), F.md5(F.array_join("l.tokens", " ")).alias("tokens"))


@R.add("m31_keyword_score", """SELECT doc_id, 2 * (contains(source, '1')::INT + contains(source, 'src2')::INT) + contains(lower(text), '1')::INT + contains(lower(text), 'src2')::INT AS score FROM documents WHERE 2 * (contains(source, '1')::INT + contains(source, 'src2')::INT) + contains(lower(text), '1')::INT + contains(lower(text), 'src2')::INT >= 2""")
def m31(t: Tables) -> DataFrame:
    score = M.keyword_score(F.col("source"), F.col("text"), ["1", "src2"])
    return t("documents").select("doc_id", score.alias("score")).where("score >= 2")


@R.add("m32_alias_resolve", """SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_name END AS role FROM part""")
def m32(t: Tables) -> DataFrame:
    """Parts' names asked for as they are, hyphenated and by an alias; the last kind is unknown."""
    k = F.col("p_partkey") % 4
    asked = F.when(k == 0, F.upper("p_name")).when(k == 1, F.regexp_replace("p_name", " ", "-")).when(k == 2, F.concat(F.lit(" The "), "p_name")).otherwise("nobody")
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("place"))
    names = names.select(F.col("p_name").alias("role"), F.array(F.concat(F.lit("the "), "p_name"), F.lit("anybody")).alias("aliases"), "place")
    return X.resolved_names(t("part").select("p_partkey", asked.alias("asked")), "asked", names, "role", "aliases", "place").select("p_partkey", "role")


KINDS = ("click", "view", "error", "signup", "purchase")
#: Skills in order, each in its own step.
NEGATED_SQL = """x0 AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'no ' || event_type || ' at all' WHEN 1 THEN upper(event_type) || ': not needed, ' || event_type WHEN 2 THEN 'some ' || event_type || ' here, not needed' WHEN 3 THEN event_type || ' and view, but no click' ELSE 'nothing of ' || repeat('-', CAST(event_id % 20 AS INTEGER)) || event_type END AS x FROM events)""" + "".join(
    f""", x{i + 1} AS (SELECT event_id, CASE WHEN p > 0 AND (contains(w, 'no ') OR contains(w, 'not')) THEN replace(x, '{k}', '') ELSE x END AS x FROM (SELECT event_id, x, p, substr(x, greatest(1, p - 18), p - greatest(1, p - 18) + {len(k)} + 8) AS w FROM (SELECT event_id, x, position('{k}' IN lower(x)) AS p FROM x{i})))"""
    for i, k in enumerate(KINDS)
)


@R.add("m33_negation", f"WITH {NEGATED_SQL} SELECT event_id, x AS text FROM x{len(KINDS)}")
def m33(t: Tables) -> DataFrame:
    k, kind = F.col("event_id") % 5, F.col("event_type")
    said = (
        F.when(k == 0, F.concat(F.lit("no "), kind, F.lit(" at all"))).when(k == 1, F.concat(F.upper(kind), F.lit(": not needed, "), kind))
        .when(k == 2, F.concat(F.lit("some "), kind, F.lit(" here, not needed"))).when(k == 3, F.concat(kind, F.lit(" and view, but no click")))
        .otherwise(F.concat(F.lit("nothing of "), F.repeat(F.lit("-"), (F.col("event_id") % 20).cast("int")), kind))
    )
    return t("events").select("event_id", M.without_negated(said, list(KINDS), ["no ", "not"]).alias("text"))


@R.add("m34_last_turns", r"""WITH c AS (SELECT conv_id, arg_max(coalesce(text, ''), CASE WHEN role = 'user' THEN turn END) AS u, arg_max(coalesce(text, ''), CASE WHEN role = 'assistant' THEN turn END) AS a FROM conversations GROUP BY 1),
    m AS (SELECT conv_id, trim(regexp_replace(CASE WHEN contains(u, ' the ') THEN substr(u, position(' the ' IN u) + 5) ELSE u END, '[\s\x{00a0}]+', ' ', 'g')) AS u, trim(regexp_replace(a, '[\s\x{00a0}]+', ' ', 'g')) AS a FROM c)
    SELECT conv_id, md5(u) AS u, md5(nullif(a, '')) AS a FROM m WHERE coalesce(u, '') <> ''""")
def m34(t: Tables) -> DataFrame:
    rows = M.conversation_records(t("conversations"), "conv_id", "turn", "role", "text", " the ")
    return rows.select("conv_id", F.md5("text").alias("u"), F.md5("summary").alias("a"))


@R.add("m35_labelled_rows", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN list_sort(list_distinct([lower(p_brand), lower(p_type)])) ELSE [lower(p_type)] END AS labels FROM part WHERE p_size % 5 > 0 AND p_size % 7 > 0""")
def m35(t: Tables) -> DataFrame:
    s = F.col("p_size")
    raw = F.array(F.when(s % 3 == 0, F.concat(F.lit(" "), "p_brand")), F.lit("  "), "p_type", F.lower("p_type"))
    rows = t("part").select("p_partkey", F.when(s % 5 > 0, F.col("p_name")).otherwise(" ").alias("text"), F.when(s % 7 > 0, raw).otherwise(F.array(F.lit(" "))).alias("labels"))
    return M.labelled_rows(rows, "text", "labels").select("p_partkey", F.transform("labels", lambda x: F.lower(x)).alias("labels"))


@R.add("m39_ordered_resolution", """WITH a AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'bolt' WHEN 1 THEN 'economy' WHEN 2 THEN 'Red Gear' ELSE 'none' END AS q FROM nation), b AS (SELECT q, p_partkey, row_number() OVER (PARTITION BY q ORDER BY (NOT contains(p_name, lower(q)))::INT, p_size, p_partkey) AS k FROM (SELECT DISTINCT q FROM a), part WHERE contains(p_name, lower(q)) OR contains(lower(p_type), lower(q)))
    SELECT n_nationkey, p_partkey FROM a LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (q)""")
def m39(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 4
    asked = t("nation").select("n_nationkey", F.when(k == 0, "bolt").when(k == 1, "economy").when(k == 2, "Red Gear").otherwise("none").alias("q"))
    catalog = t("part").withColumn("place", F.struct("p_size", "p_partkey"))
    return X.first_in_catalog(asked, "q", catalog, "p_partkey", "p_name", "p_type", "place").select("n_nationkey", "p_partkey")


@R.add("m09_role_scores", f"WITH {MATCH_SQL} SELECT p_partkey, role, round(score, 6) AS score, how FROM final WHERE score > 0")
def m09(t: Tables) -> DataFrame:
    return scored(t).select("p_partkey", "role", "score", F.col("by").alias("how"))


@R.add("m29_required_and_nice", r"""WITH l AS (SELECT doc_id, lower(text) AS x, string_split(lower(text), chr(10)) AS l FROM documents), s AS (SELECT doc_id, list_filter(['the', 'que', 'idiot', 'token', 'mit'], lambda s: contains(x, s)) AS held, list_filter(['the', 'que', 'idiot', 'token', 'mit'], lambda s: len(list_filter(l, lambda y: contains(y, s) AND regexp_matches(y, 'license|[0-9]{3}'))) > 0) AS nice FROM l)
    SELECT doc_id, list_filter(held, lambda s: NOT list_contains(nice, s)) AS required, nice FROM s""")
def m29(t: Tables) -> DataFrame:
    required, nice = M.required_and_nice(F.col("text"), X.array_of(["the", "que", "idiot", "token", "mit"]), "license|[0-9]{3}")
    return t("documents").select("doc_id", required.alias("required"), nice.alias("nice"))
