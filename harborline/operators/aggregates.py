"""Grouped features, weighted averages, coverage statistics and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.normalise import sigmoid, with_zscores
from harborline.operators.relational import grouped_quantile, null_safe, small, top_per_key


def posting_features(
    rows: DataFrame, keys: list[str], company: str, salary: str, remote: Column, education: str, years: str, hits: Column, source: str,
    as_of: Column, month: str, digits: int = 3, mean_digits: int = 6,
) -> DataFrame:
    """Per group: postings, distinct companies, mean and median salary, shares of remote work and of bachelor's and master's
    degrees, mean years, mean of a tenth of the skill hits, and sources; the month of as_of and later left out."""
    past = rows.where(F.col(month) < F.trunc(as_of, "month"))
    blank = F.trim(F.col(company).cast("string")) == ""
    asks = lambda degree: F.contains(F.lower(F.coalesce(education, F.lit(""))), F.lit(degree)).cast("double")
    found = past.groupBy(*keys).agg(
        F.count("*").alias("job_post_count"),
        F.count_distinct(F.when(~blank, F.col(company))).alias("unique_company_count"),
        F.round(F.avg(salary), digits).alias("avg_salary"),
        F.round(F.avg(F.coalesce(remote, F.lit(False)).cast("double")), 6).alias("remote_share"),
        F.round(F.avg(asks("bachelor")), 6).alias("bachelor_share"),
        F.round(F.avg(asks("master")), 6).alias("master_share"),
        F.round(F.avg(years), mean_digits).alias("avg_years"),
        F.round(F.avg(F.coalesce(hits, F.lit(0)) / 10.0), mean_digits).alias("hit_rate"),
        F.count_distinct(source).alias("source_count"),
    )
    median = grouped_quantile(past, keys, salary, 0.5, "median_salary").withColumn("median_salary", F.round("median_salary", digits))
    return null_safe(found, median, keys, "left")


def weighted_index(groups: DataFrame, weights: dict[str, float], name: str, fill: float | None = 0.0) -> DataFrame:
    """Sigmoid of the weighted z-scores of the groups, rounded."""
    z = with_zscores(groups, list(weights), fill=fill)
    total = sum((F.col(f"{c}_z") * w for c, w in weights.items()), F.lit(0.0))
    return z.withColumn(name, F.round(sigmoid(total), 6)).drop(*[f"{c}_z" for c in weights])


def blended(values: list[tuple[Column, float]], otherwise: float = 0.5) -> Column:
    """Weighted mean of the values above 0, weights renormalised over those present."""
    present = lambda v: F.coalesce(v > 0, F.lit(False))
    total = sum((F.when(present(v), v * w).otherwise(0.0) for v, w in values), F.lit(0.0))
    weight = sum((F.when(present(v), w).otherwise(0.0) for v, w in values), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(otherwise)


def news_features(rows: DataFrame, keys: list[str], tone: str, domain: str, risk: str, opportunity: str, weight: str | None = None) -> DataFrame:
    """Per group: articles, mean tone, shares of positive and negative ones, their difference, sentiment, mean risk and opportunity,
    and distinct domains, trimmed and case aside.

    With a weight all are weighted, and the divisor and count are never below 1, which damps small groups.
    """
    w = F.col(weight) if weight else F.lit(1)
    t = F.coalesce(F.col(tone), F.lit(0.0))
    n = F.greatest(F.sum(w), F.lit(1.0) if weight else F.lit(1))
    mean = lambda x: F.sum(w * x) / n
    name = F.lower(F.trim(domain))
    g = rows.groupBy(*keys).agg(
        n.alias("articles"), mean(t).alias("tone"), mean((t > 0).cast("double")).alias("positive"), mean((t < 0).cast("double")).alias("negative"),
        mean(F.col(risk)).alias("risk"), mean(F.col(opportunity)).alias("opportunity"), F.count_distinct(F.when(name != "", name)).alias("domains"),
    )
    net = F.col("positive") - F.col("negative")
    g = g.withColumn("net", net).withColumn("sentiment", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("tone") / 10 + net)))
    articles = F.round("articles", 6) if weight else F.col("articles")
    return g.select(*keys, "domains", articles.alias("articles"), *[F.round(c, 6).alias(c) for c in ("tone", "positive", "negative", "net", "sentiment", "risk", "opportunity")])


def impact(features: DataFrame, docs: DataFrame, keys: list[str], tone: str, risk: str, opportunity: str, band: float = 0.08) -> DataFrame:
    """features with the documents' counts and means, 0 where there are none, the impact score and its direction: .5 of the
    sentiment, .3 of the mean of both opportunities less .2 of the mean of both risks."""
    side = docs.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("doc_articles"), F.avg(F.coalesce(F.col(tone), F.lit(0.0))).alias("doc_tone"), F.avg(opportunity).alias("doc_opportunity"), F.avg(risk).alias("doc_risk")
    )
    both = features.join(side, keys, "left").fillna(0, ["doc_articles", "doc_tone", "doc_opportunity", "doc_risk"])
    score = 0.5 * F.col("sentiment") + 0.3 * (F.col("opportunity") + F.col("doc_opportunity")) / 2 - 0.2 * (F.col("risk") + F.col("doc_risk")) / 2
    both = both.withColumn("impact", F.round(score, 6))
    return both.withColumn("direction", F.when(F.col("impact") > band, "positive").when(F.col("impact") < -band, "negative").otherwise("neutral"))


def extraction_stats(records: DataFrame, source: str, skills: str) -> DataFrame:
    """Per source: records, those with a skill, mentions, coverage and mean number of skills."""
    n = F.coalesce(F.size(skills), F.lit(0))
    return records.groupBy(source).agg(
        F.count("*").alias("total"), F.count_if(n > 0).alias("with_skills"), F.sum(n).alias("mentions"),
        F.round(F.avg((n > 0).cast("double")), 4).alias("coverage"), F.round(F.avg(n), 2).alias("average"),
    )


def most_frequent(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(columns, n): the n most frequent combinations without a null, ties by value; counted before they are sorted."""
    counts = rows.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), *columns).limit(n)


def weighted_average(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Null values drop their weight; all weights zero: equal weights; nothing: 0."""
    v, w = F.col(value), F.col(weight)
    seen = F.when(v.isNotNull(), w)
    average = F.when(F.sum(seen) > 0, F.sum(v * w) / F.sum(seen)).otherwise(F.avg(v))
    return rows.groupBy(*keys).agg(F.coalesce(average, F.lit(0.0)).alias(value))


def top_values(rows: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    """The n most frequent values of each key, ties by value, as an ordered list."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.col("__n").desc(), F.col(value))
    top = counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    lists = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", value))).alias("__l"))
    return lists.select(*keys, F.transform("__l", lambda x: x[value]).alias(name))


def mode_and_any(rows: DataFrame, key: str, category: str, flag: str) -> DataFrame:
    """Most frequent category of each key (ties: the smallest) and whether any flag is set."""
    counts = rows.groupBy(key, category).agg(F.count("*").alias("n"), F.bool_or(flag).alias("any"))
    best = F.min_by(category, F.struct((-F.col("n")).alias("a"), F.col(category).alias("b")))
    return counts.groupBy(key).agg(best.alias(category), F.bool_or("any").alias(flag))


def counts_by_sets(rows: DataFrame, sets: list[str], flags: dict[str, Column]) -> DataFrame:
    """total and flag counts by each column of sets alone, in one pass with grouping sets."""
    marked = rows.select(*[F.col(c).cast("string").alias(c) for c in sets], *[c.alias(n) for n, c in flags.items()])
    grouped = marked.groupingSets([[F.col(c)] for c in sets], *[F.col(c) for c in sets]).agg(
        F.count("*").alias("total"), *[F.count_if(n).alias(n) for n in flags], F.grouping_id().alias("__g")
    )
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(sets):
        mask = ((1 << len(sets)) - 1) ^ (1 << (len(sets) - 1 - i))
        kind, value = F.when(F.col("__g") == mask, c).otherwise(kind), F.when(F.col("__g") == mask, F.col(c)).otherwise(value)
    return grouped.select(kind.alias("by"), value.alias("key"), "total", *flags)


def coverage(rows: DataFrame, item: str, group: str, weight: str, groups_total: Column, generic: list[str], parts: list[str], most: int = 30, some: int = 20, short: int = 4) -> DataFrame:
    """Per item: groups that hold it, their share of all, total and mean weight, and whether it is common: in `most` groups, or in
    `some` and generic, with a generic part, or of `short` characters at most.  Items are trimmed, blank ones left out."""
    named = rows.withColumn(item, F.trim(item)).where(F.col(item) != "")
    g = named.groupBy(item).agg(F.count_distinct(group).alias("groups"), F.round(F.sum(F.coalesce(F.col(weight).cast("double"), F.lit(0.0))), 6).alias("total"))
    low = F.lower(item)
    plain = reduce(lambda a, p: a | F.contains(low, F.lit(p)), parts, low.isin(*generic, "")) | (F.length(item) <= short)
    g = g.withColumn("share", F.round(F.col("groups") / groups_total, 6)).withColumn("weight", F.round(F.col("total") / F.col("groups"), 6))
    return g.withColumn("common", (F.col("groups") >= most) | ((F.col("groups") >= some) & plain))


def specificity(
    rows: DataFrame, group: str, item: str, score: str, stats: DataFrame, items_total: int, n: int, role_hints: Column, category_hints: Column, penalties: Column,
    generic: list[str], stop: list[str], parts: list[str],
) -> DataFrame:
    """(group, item, score, specific, rank): the n most specific items of each group, by score * ln((items + 1) / (groups with it + 1)).

    Common items count .28, those with a generic part .85; hints of the role 3 (2.3 where one holds the other), of the category
    1.8 (1.35), and items in at most three groups 1.15.  Generic, stop and penalised items and those of fewer than
    three characters are left out.  stats: coverage(); hints: array columns in lower case.  Ties: score, rarer, longer, name.
    """
    name, low = F.trim(item), F.lower(F.trim(item))
    holds = lambda hints: F.exists(hints, lambda h: F.contains(low, h) | F.contains(h, low))
    penalised = F.exists(penalties, lambda p: F.contains(low, p))
    kept = rows.where((F.length(name) >= 3) & ~low.isin(*generic, *stop, "") & ~F.coalesce(penalised, F.lit(False)))
    known = stats.select(F.col(item).alias("__item"), F.col("groups").alias("__groups"), F.col("common").alias("__common"))
    kept = kept.join(small(known), name == F.col("__item"), "left")
    held = F.coalesce(F.col("__groups"), F.lit(1))
    times = F.when(F.array_contains(role_hints, low), 3.0).when(holds(role_hints), 2.3).otherwise(1.0)
    times = times * F.when(F.array_contains(category_hints, low), 1.8).when(holds(category_hints), 1.35).otherwise(1.0) * F.when(held <= 3, 1.15).otherwise(1.0)
    times = times * F.when(F.coalesce("__common", F.lit(False)), 0.28).otherwise(1.0)
    times = times * F.when(reduce(lambda a, p: a | F.contains(low, F.lit(p)), parts, F.lit(False)), 0.85).otherwise(1.0)
    base = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) * F.log((items_total + 1) / (held + 1))
    scored = kept.select(group, item, score, held.alias("__groups"), F.round(base * times, 9).alias("specific"))
    order = [F.col("specific").desc(), F.col(score).desc(), F.col("__groups"), F.length(F.trim(item)).desc(), F.col(item)]
    return top_per_key(scored, [group], order, n).drop("__groups")


def vocabulary_conflicts(rows: DataFrame, order: str, id_: str, name: str, aliases: str) -> tuple[DataFrame, DataFrame]:
    """(alias, id) as the first entry in order claims it, and the conflicts (kind, id, alias, kept): repeated ids, whose later
    entries are left out, and aliases that a later entry claims too.  An entry's aliases are its name, its id with and
    without hyphens, and those listed, in lower case."""
    first = rows.groupBy(id_).agg(F.min(order).alias("__first"))
    placed = rows.join(first, id_)
    repeats = placed.where(F.col(order) > F.col("__first")).select(F.lit("dup_id").alias("kind"), F.col(id_).alias("id"), F.lit(None).cast("string").alias("alias"), F.col(id_).alias("kept"))
    forms = F.array_distinct(F.transform(F.concat(F.array(name, F.replace(id_, F.lit("-"), F.lit(" ")), id_), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: F.lower(a)))
    each = placed.where(F.col(order) == F.col("__first")).select(F.col(id_).alias("id"), F.col(order).alias("__o"), F.explode(forms).alias("alias"))
    owners = each.groupBy("alias").agg(F.min_by("id", "__o").alias("kept"))
    claims = each.join(owners, "alias").where(F.col("id") != F.col("kept")).select(F.lit("dup_alias").alias("kind"), "id", "alias", "kept")
    return owners.select("alias", F.col("kept").alias("id")), repeats.unionByName(claims)


def spelling_groups(rows: DataFrame, key: Column, spelling: str) -> DataFrame:
    """Keys with several spellings, the spellings sorted, and how often they occur."""
    g = rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(spelling)).alias("spellings"), F.count("*").alias("n"))
    return g.where(F.size("spellings") > 1)


def merged_clusters(profiles: DataFrame, final: str, size: str, item: str, share: str) -> DataFrame:
    """Size-weighted share of each item over the clusters that merge into one; clusters without it count as 0."""
    sizes = profiles.select(final, "cluster", size).distinct().groupBy(final).agg(F.sum(size).alias("__size"))
    parts = profiles.groupBy(final, item).agg(F.sum(F.col(share) * F.col(size)).alias("__sum"))
    return parts.join(sizes, final).select(final, item, F.round(F.col("__sum") / F.col("__size"), 4).alias(share))
