"""Role taxonomies: cluster profiles, merges with lineage, names and quality, aliases and terms, corpus summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators.aggregates import merged_clusters, top_values
from harborline.operators.relational import top_per_key

#: Shares of core and optional skills, and how many of each.
CORE, CORE_FALLBACK, CORE_LEAST, CORE_MOST = 0.20, 0.12, 3, 5
OPTIONAL, OPTIONAL_MOST = 0.08, 5
#: Roles of a common alias, or of one that is generic or short.
COMMON_ROLES, GENERIC_ROLES, SHORT_ALIAS = 30, 20, 4
SENIORITY = r"(?i)\b(senior|junior|middle|lead|principal|staff|sr\.?|jr\.?)\b"


def cluster_profiles(rows: DataFrame, cluster: str, id_: str, source: str, title: str, skills: str, keywords: str, n: int = 5) -> DataFrame:
    """(cluster, size, first_id, source_mix, titles, skills, keywords, skill_freq): counts by source, the n most
    frequent titles, skills and keywords, and each skill's share of the cluster's rows (4 dp)."""
    size = rows.groupBy(cluster).agg(F.count("*").alias("size"), F.min(id_).alias("first_id"))
    mix = rows.groupBy(cluster, source).agg(F.count("*").alias("__n")).groupBy(cluster).agg(_as_map(source, "__n").alias("source_mix"))
    each = lambda c: rows.select(cluster, F.explode(F.array_distinct(c)).alias("__v"))
    freq = each(skills).groupBy(cluster, "__v").agg(F.count("*").alias("__n")).join(size, cluster)
    freq = freq.select(cluster, "__v", F.round(F.col("__n") / F.col("size"), 4).alias("__s")).groupBy(cluster).agg(_as_map("__v", "__s").alias("skill_freq"))
    out = size.join(mix, cluster).join(top_values(rows.where(F.trim(title) != ""), [cluster], title, n, "titles"), cluster, "left")
    for c in (skills, keywords):
        out = out.join(top_values(each(c), [cluster], "__v", n, c), cluster, "left")
    return out.join(freq, cluster, "left")


def _as_map(key: str, value: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))


def core_and_optional(profiles: DataFrame, final: str, size: str, item: str, share: str) -> DataFrame:
    """(final, core, optional) of clusters that merge, by their size-weighted shares, ties by name.

    Core: every item from the core share on, filled up to three by the fallback share, five at most; optional:
    the others from the optional share on, five at most.
    """
    merged = merged_clusters(profiles, final, size, item, share).where(F.col(share) >= OPTIONAL)
    lists = merged.groupBy(final).agg(F.array_sort(F.collect_list(F.struct((-F.col(share)).alias("s"), F.col(item).alias("v")))).alias("l"))
    strict, near = F.size(F.filter("l", lambda x: -x["s"] >= CORE)), F.size(F.filter("l", lambda x: -x["s"] >= CORE_FALLBACK))
    n = F.least(F.lit(CORE_MOST), F.greatest(strict, F.least(near, F.lit(CORE_LEAST))))
    names = F.transform("l", lambda x: x["v"])
    return lists.select(final, F.slice(names, F.lit(1), n).alias("core"), F.slice(names, n + 1, F.lit(OPTIONAL_MOST)).alias("optional"))


def merge_lineage(roles: DataFrame, id_: str, name: str, size: str, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, dropped, summary) of a decision table (id, final, confidence, note, reason).

    merged: final, size, sources (id, name, size, confidence, note); dropped: id, name, size, reason, for
    decisions without a final name ("undecided" without a decision); summary: counts and sizes, one row.
    """
    told = roles.join(decisions, id_, "left")
    kept, gone = told.where("final IS NOT NULL"), told.where("final IS NULL")
    source = F.struct(id_, F.col(name).alias("name"), F.col(size).alias("size"), "confidence", "note")
    merged = kept.groupBy("final").agg(F.sum(size).alias("size"), F.array_sort(F.collect_list(source)).alias("sources"))
    dropped = gone.select(id_, name, size, F.coalesce("reason", F.lit("undecided")).alias("reason"))
    summary = told.agg(
        F.count("*").alias("before"), F.count_distinct("final").alias("after"), F.count_if(F.col("final").isNull()).alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("final").isNotNull(), F.col(size))), F.lit(0)).alias("kept_size"),
        F.coalesce(F.sum(F.when(F.col("final").isNull(), F.col(size))), F.lit(0)).alias("dropped_size"),
    )
    return merged, dropped, summary


def cluster_names(clusters: DataFrame, id_: str, bucket: str, keywords: str, skills: str, titles: str, keyword_rules: dict[str, list[str]], skill_rules: dict[str, list[str]], plain: list[str]) -> DataFrame:
    """Add name: by the first keyword rule met, else the first skill rule, else the top keyword unless it is plain,
    else the top title without seniority, else the bucket.  Of equal names in a bucket the later ones, by id,
    get a hint: their first keyword or skill that the name does not hold, else their number."""
    text = F.lower(F.array_join(keywords, " "))
    first = lambda rules, test: F.coalesce(*[F.when(test(words), name) for name, words in rules.items()], F.lit(None).cast("string"))
    by_keyword = first(keyword_rules, lambda ws: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in ws]))
    by_skill = first(skill_rules, lambda ws: F.arrays_overlap(skills, F.array(*[F.lit(w) for w in ws])))
    top = F.get(keywords, F.lit(0))
    title = F.regexp_replace(F.regexp_replace(F.get(titles, F.lit(0)), SENIORITY, ""), r"\s+", " ")
    title = F.regexp_replace(title, r"^[ /-]+|[ /-]+$", "")
    name = F.coalesce(by_keyword, by_skill, F.when(~F.lower(top).isin(*plain) & (top != ""), top), F.when(title != "", title), bucket)
    named = clusters.withColumn("name", name)
    named = named.withColumn("__n", F.row_number().over(Window.partitionBy(bucket, "name").orderBy(id_)))
    hints = F.filter(F.concat(F.coalesce(keywords, F.array()), F.coalesce(skills, F.array())), lambda c: (F.trim(c) != "") & ~F.contains(F.lower("name"), F.lower(c)) & ~F.lower(c).isin(*plain))
    hint = F.coalesce(F.get(hints, F.lit(0)), F.col("__n").cast("string"))
    return named.withColumn("name", F.when(F.col("__n") > 1, F.concat("name", F.lit(" ("), hint, F.lit(")"))).otherwise(F.col("name"))).drop("__n")


def good_clusters(named: DataFrame, bucket: str, keywords: str, skills: str, titles: str, rejected: list[str], weak_skills: list[str], least: dict[str, int], signals: list[str]) -> DataFrame:
    """Clusters without a rejected term in name, keywords or titles, and with as many strong skills as their bucket
    asks for (`least`; other buckets none); a keyword signal stands for the skills where two are asked for."""
    text = F.lower(F.concat_ws(" ", F.col("name"), F.array_join(keywords, " "), F.array_join(F.slice(titles, 1, 5), " ")))
    bad = reduce(lambda a, b: a | b, [F.contains(text, F.lit(r)) for r in rejected], F.lit(False))
    strong = F.size(F.array_except(skills, F.array(*[F.lit(w) for w in weak_skills]).cast("array<string>")))
    asked = reduce(lambda c, kv: F.when(F.col(bucket) == kv[0], kv[1]).otherwise(c), least.items(), F.lit(0))
    signal = reduce(lambda a, b: a | b, [F.contains(F.lower(F.array_join(keywords, " ")), F.lit(s)) for s in signals], F.lit(False))
    return named.where(~bad & ((strong >= asked) | ((asked == 2) & signal)))


def alias_coverage(aliases: DataFrame, alias: str, role: str, listed: list[str], generic: list[str]) -> DataFrame:
    """(alias, roles, common): common if listed, or of many roles, or of fairly many and generic or short."""
    g = aliases.groupBy(F.lower(alias).alias(alias)).agg(F.count_distinct(role).alias("roles"))
    dull = reduce(lambda a, w: a | F.contains(alias, F.lit(w)), generic, F.length(alias) <= SHORT_ALIAS)
    return g.withColumn("common", F.col(alias).isin(*listed) | (F.col("roles") >= COMMON_ROLES) | ((F.col("roles") >= GENERIC_ROLES) & dull))


def term_roles(terms: DataFrame, term: str, role: str, identity: DataFrame, most: int = 12) -> DataFrame:
    """(term, roles): terms of at most `most` roles, and identity terms (column term) whatever their number.

    Counted before gathering, so that only kept terms are gathered.
    """
    pairs = terms.select(term, role).distinct()
    count = pairs.groupBy(term).agg(F.count("*").alias("__n")).join(identity.select(term).distinct().withColumn("__own", F.lit(True)), term, "left")
    kept = count.where((F.col("__n") <= most) | F.col("__own")).select(term)
    return pairs.join(kept, term, "left_semi").groupBy(term).agg(F.array_sort(F.collect_list(role)).alias("roles"))


def resource_groups(pairs: DataFrame, skill: str, resource: str, source: str, score: str, place: str, n: int) -> DataFrame:
    """(skill, resource, rank, resources, sources): the n best resources of each skill, by score and then place,
    with how many resources and sources the skill has."""
    best = pairs.groupBy(skill, resource, source).agg(F.max(score).alias(score), F.min(place).alias(place))
    count = best.groupBy(skill).agg(F.count_distinct(resource).alias("resources"), F.count_distinct(source).alias("sources"))
    top = top_per_key(best, [skill], [F.col(score).desc(), F.col(place), F.col(resource)], n)
    return top.select(skill, resource, "rank").join(count, skill)


def span_summary(rows: DataFrame, spans: str, n: int = 200) -> DataFrame:
    """One row: rows read, rows with a span, mentions, distinct spans (case aside), and the n most frequent."""
    each = rows.select(F.explode(F.transform(spans, lambda s: F.lower(s))).alias("span")).groupBy("span").agg(F.count("*").alias("n"))
    read = rows.agg(F.count("*").alias("rows"), F.count_if(F.size(spans) > 0).alias("with_spans"))
    counts = each.agg(F.count("*").alias("spans"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))
    top = each.orderBy(F.col("n").desc(), "span").limit(n)
    top = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "span"))), lambda x: x["span"]).alias("top"))
    return read.crossJoin(counts).crossJoin(top)  # one row each


def label_summary(rows: DataFrame, set_: str, labels: str, n: int = 5) -> DataFrame:
    """(set, rows, labels, samples): rows and distinct labels of each set, and its n first labels."""
    size = rows.groupBy(set_).agg(F.count("*").alias("rows"))
    each = rows.select(set_, F.explode(labels).alias("__l")).distinct()
    count = each.groupBy(set_).agg(F.count("*").alias("labels"))
    first = top_per_key(each, [set_], [F.col("__l")], n).groupBy(set_).agg(F.array_sort(F.collect_list("__l")).alias("samples"))
    return size.join(count, set_, "left").join(first, set_, "left")


def unmatched_ngrams(docs: DataFrame, text: str, known: DataFrame, term: str, generic: list[str], shortest: int = 3, longest: int = 3, n: int = 100) -> DataFrame:
    """(term, n): the most frequent runs of 1 to `longest` words of letters, +, # and ., scanned from the left
    without overlaps, but known terms, generic words, short ones and bare digits."""
    pattern = rf"[a-z0-9+#][a-z0-9+#.]*(?: [a-z0-9+#][a-z0-9+#.]*){{0,{longest - 1}}}"
    each = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias(term))
    counts = each.groupBy(term).agg(F.count("*").alias("n"))  # before the join: a row for each term
    kept = counts.where((F.length(term) >= shortest) & ~F.col(term).isin(*generic) & ~F.rlike(term, F.lit("^[0-9. ]+$")))
    return kept.join(known.select(F.lower(term).alias(term)).distinct(), term, "left_anti").orderBy(F.col("n").desc(), term).limit(n)
