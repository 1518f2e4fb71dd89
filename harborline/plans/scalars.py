"""Scalar normalisation over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import normalise as N
from harborline.plans.registry import Registry, Tables

R = Registry()
#: Fixed values for these plans.
STOP = ["the", "of", "and", "to", "a", "in"]
POSITIVE, NEGATIVE = ["ing", "tion", "good"], ["idiot", "trash", "th"]
GENERIC = ["ring", "widget", "gear"]


def _stamps(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    shape = F.col("o_orderkey") % 7
    text = (
        F.when(shape == 0, F.date_format(d, "yyyyMMddHHmmss"))
        .when(shape == 1, F.date_format(d, "yyyyMMdd"))
        .when(shape == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(shape == 3, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00 x")))
        .when(shape == 5, F.concat(F.date_format(d, "yyyy-MM-dd'T'10:20:30.250"), F.lit("Z")))
        .when(shape == 6, F.concat(F.date_format(d, "yyyy-MM-dd 23:20:30"), F.lit("-02:00")))
        .otherwise("soon")
    )
    return t("orders").select("o_orderkey", text.alias("stamp"), F.unix_timestamp(d).alias("s"))


@R.add("n01_month_start", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 4 THEN CAST(date_trunc('month', CASE WHEN o_orderkey % 7 = 6 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END) AS DATE) END AS month,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month_of_ms FROM orders WHERE epoch(o_orderdate) > 0""")
def month_start(t: Tables) -> DataFrame:
    s = _stamps(t).where("s > 0")
    ms = F.when(F.col("s") * 1000 > 1e12, N.timestamp_of_number((F.col("s") * 1000).cast("double"))).otherwise(
        N.timestamp_of_number(F.date_format(F.timestamp_seconds("s"), "yyyyMMdd").cast("double"))
    )
    return s.select("o_orderkey", N.month_start(N.timestamp_of(F.col("stamp"))).alias("month"), N.month_start(ms).alias("month_of_ms"))


@R.add("n02_timestamp", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN NULL WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d 10:20:30.250') WHEN 6 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d 01:20:30.000') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.000') END AS stamp FROM orders""")
def timestamps(t: Tables) -> DataFrame:
    return _stamps(t).select("o_orderkey", F.date_format(N.timestamp_of(F.col("stamp")), "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp"))


@R.add("n03_not_before", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-03-01'")
def not_before(t: Tables) -> DataFrame:
    return t("orders").where(F.col("o_orderdate") >= F.lit("1999-03-01").cast("timestamp")).where(
        N.not_before(F.col("o_orderdate"), F.lit("1999-03-20").cast("date"))
    ).select("o_orderkey")


@R.add("n04_first_number", r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS years FROM documents""")
def first_number(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", N.first_number(F.col("text")).alias("years"))


@R.add("n05_finite", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN value END AS x FROM events""")
def finite(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, "NaN").when(kind == 1, "Infinity").when(kind == 2, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return t("events").select("event_id", N.finite_or_null(text).alias("x"))


@R.add("n06_listed", """SELECT p_partkey, replace(p_name, ' ', ',') || ',' || lower(p_type) AS items FROM part""")
def listed(t: Tables) -> DataFrame:
    parts = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    text = F.when(F.col("p_partkey") % 2 == 0, F.to_json(parts)).otherwise(F.concat(F.array_join(parts, " ; "), F.lit(";; ")))
    return t("part").select("p_partkey", F.array_join(N.listed(text), ",").alias("items"))


@R.add("n07_work_arrangement", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'remote' WHEN 'F' THEN 'onsite' ELSE lower(o_orderpriority) END AS arrangement FROM orders""")
def work_arrangement(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    text = F.when(s == "O", "Fully REMOTE or hybrid").when(s == "F", " In the Office ").otherwise(F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", N.work_arrangement(text).alias("arrangement"))


@R.add("n08_remote_bucket", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 101 >= 90 THEN 'remote' WHEN o_orderkey % 101 >= 30 THEN 'hybrid' ELSE 'onsite' END AS bucket FROM orders""")
def remote_bucket(t: Tables) -> DataFrame:
    ratio = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 101)
    return t("orders").select("o_orderkey", N.remote_bucket(ratio).alias("bucket"))


@R.add("n09_slug_hash", """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
    md5(concat(CAST(p_partkey AS VARCHAR), '||', CASE WHEN p_size > 25 THEN '' ELSE p_name END, '||', p_brand)) AS id FROM part""")
def slug_hash(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") <= 25, F.col("p_name"))
    return t("part").select(
        "p_partkey", N.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"),
        N.hash_id(F.col("p_partkey"), name, F.col("p_brand")).alias("id"),
    )


@R.add("n10_token_set", """SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9+#.]+')),
    lambda x: x <> '' AND x NOT IN ('the','of','and','to','a','in'))), ' ') AS tokens FROM benchmark""")
def token_set(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.array_join(F.array_sort(N.token_set(F.col("text"), STOP)), " ").alias("tokens"))


@R.add("n11_alias_lookup", """SELECT p_partkey, upper(p_name) AS name FROM part""")
def alias_lookup(t: Tables) -> DataFrame:
    names = t("part").select("p_name").distinct()
    aliases = names.select(N.lookup_key(F.col("p_name")).alias("alias_key"), F.upper("p_name").alias("name"))
    raw = t("part").select("p_partkey", F.concat(F.lit(" -* "), F.regexp_replace(F.initcap("p_name"), " ", "   "), F.lit(" . ")).alias("raw"))
    return N.resolve_names(raw, "raw", aliases).select("p_partkey", "name")


@R.add("n12_tone", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS tone FROM events")
def tone(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "n/a,3").otherwise(F.concat_ws(",", F.col("value").cast("string"), F.lit("1.5,2")))
    return t("events").select("event_id", N.tone(text).alias("tone"))


@R.add("n13_url_host", r"""SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages""")
def url_host(t: Tables) -> DataFrame:
    text = F.concat(F.lit("n/a<UDIV>"), F.col("url"), F.lit("<UDIV>http://other.example"))
    url = N.first_url(text)
    return t("pages").select("page_id", url.alias("url"), N.host(url).alias("host"))


@R.add("n14_title_from_url", r"""WITH a AS (SELECT p_partkey, p_brand, substr(replace(p_name, ' ', '-') || '_' || p_type, 1, 120) AS s FROM part)
    SELECT p_partkey, CASE WHEN length(s) < 8 THEN p_brand ELSE replace(replace(s, '-', ' '), '_', ' ') END AS title FROM a""")
def title_from_url(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://x.example/a/"), F.translate("p_name", " ", "-"), F.lit("_"), F.col("p_type"), F.lit(".html/?q=1"))
    return t("part").select("p_partkey", N.title_from_url(url, F.col("p_brand")).alias("title"))


@R.add("n15_title_signature", """SELECT item_id, array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 7), ' ') AS sig FROM benchmark""")
def title_signature(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", N.title_signature(F.col("text")).alias("sig"))


@R.add("n16_redacted", r"""WITH d AS (SELECT doc_id, '  ' || text || CASE WHEN doc_id % 3 = 0 THEN ' see WWW.x.org/a or LinkedIn.com/in/b,  c' ELSE '' END || chr(10) AS text FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
    '(?i)(https?://|www\.|linkedin\.com/)[^ \n\t]+', '[URL]', 'g'), '\+?[0-9][0-9 ().\n\t-]{7,}[0-9]', '[PHONE]', 'g'), '[ \t]+', ' ', 'g'), '^[ \n\t]+|[ \n\t]+$', '', 'g')) AS digest FROM d""")
def redacted(t: Tables) -> DataFrame:
    more = F.when(F.col("doc_id") % 3 == 0, " see WWW.x.org/a or LinkedIn.com/in/b,  c").otherwise("")
    return t("documents").select("doc_id", F.md5(N.redacted(F.concat(F.lit("  "), "text", more, F.lit("\n")))).alias("digest"))


@R.add("n17_skill_list", """SELECT p_partkey, p_name || '|' || p_type AS skills FROM part""")
def skill_list(t: Tables) -> DataFrame:
    text = F.concat(F.lit("['"), F.col("p_name"), F.lit("', "), F.upper("p_name"), F.lit(" ;"), F.col("p_type"), F.lit("| "), F.lower("p_type"), F.lit(".]"))
    return t("part").select("p_partkey", F.array_join(N.skill_list(text), "|").alias("skills"))


@R.add("n18_basic_key", "SELECT p_partkey, lower(p_name) AS k FROM part")
def basic_key(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", N.basic_key(F.concat(F.lit(" /,"), F.regexp_replace(F.upper("p_name"), " ", "  "), F.lit(".- "))).alias("k"))


@R.add("n19_clamp", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(greatest((event_id - 5000) * 1000000, 0), 2147483647) END AS n FROM events")
def clamp(t: Tables) -> DataFrame:
    n = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") - 5000) * 1000000)
    return t("events").select("event_id", N.clamp_int32(n).alias("n"))


@R.add("n20_zscore_sigmoid", """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z,
    round(1 / (1 + exp(-(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ())), 6) AS p FROM customer""")
def zscore(t: Tables) -> DataFrame:
    z = N.with_zscores(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return z.select("c_custkey", F.round("c_acctbal_z", 6).alias("z"), F.round(N.sigmoid(F.col("c_acctbal_z")), 6).alias("p"))


@R.add("n21_hint_sentiment", """WITH h AS (SELECT doc_id, contains(lower(text),'ing')::INT + contains(lower(text),'tion')::INT + contains(lower(text),'good')::INT AS p,
    contains(lower(text),'idiot')::INT + contains(lower(text),'trash')::INT + contains(lower(text),'th')::INT AS n FROM documents)
    SELECT doc_id, round((p - n) / greatest(p + n, 1), 6) AS sentiment FROM h""")
def hint_sentiment(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.round(N.hint_sentiment(F.col("text"), POSITIVE, NEGATIVE), 6).alias("sentiment"))


@R.add("n22_completeness", """SELECT doc_id, round(0.5 * least(length(text) / 1000, 1.0) + 0.3 * least(len(string_split(text, '.')) / 10, 1.0)
    + CASE WHEN lang = 'en' THEN 0.1 ELSE 0.0 END + CASE WHEN source = 'src0' THEN 0.1 ELSE 0.0 END, 6) AS quality FROM documents""")
def completeness(t: Tables) -> DataFrame:
    parts = F.size(F.split("text", r"\.", -1))
    q = N.completeness(F.length("text"), parts, [F.col("lang") == "en", F.col("source") == "src0"], 1000, 10)
    return t("documents").select("doc_id", q.alias("quality"))


@R.add("n23_role_phrase", """SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 2) IN ('ring','widget','gear') THEN split_part(p_name, ' ', 1) END AS phrase FROM part""")
def role_phrase(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", N.role_phrase(F.col("p_name"), GENERIC).alias("phrase"))


@R.add("n24_month_offset_age", """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS ahead,
    greatest((1999 - year(o_orderdate)) * 12 + 6 - month(o_orderdate), 0)::INT AS age FROM orders""")
def month_offset(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", N.month_offset(d, 3).alias("ahead"), N.month_age(d, F.lit("1999-06-30").cast("date")).alias("age"))


@R.add("n25_labelled_number", """SELECT event_id, round(value - 20, 3) AS tone FROM events""")
def labelled_number(t: Tables) -> DataFrame:
    text = F.concat(F.lit("seen 12 times, Tone = "), F.format_string("%.4f", F.col("value") - 20), F.lit("; end 3"))
    return t("events").select("event_id", N.labelled_number(text, "tone").alias("tone"))


@R.add("n26_event_key", "SELECT page_id, 'E-' || substr(sha1(url), 1, 12) AS k FROM pages")
def event_key(t: Tables) -> DataFrame:
    return t("pages").select("page_id", N.event_key("E-", F.col("url")).alias("k"))


@R.add("n27_clean_blanks", r"""SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\r\n\f]+', ' ', 'g'))) AS digest FROM documents""")
def clean_blanks(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(N.clean_blanks(F.col("text"))).alias("digest"))
