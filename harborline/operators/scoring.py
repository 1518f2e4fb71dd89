"""Scores, gates and assembled rows on top of matching, series, retrieval and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators.matching import tokens
from harborline.operators.relational import MOST_DOCS, dealt, small, top_per_key
from harborline.sources.scratch import cut

#: Rows of (key, item) about which a task takes; each meets the others that have its item.
MOST_PAIRS = 400_000


def keyword_filter(df: DataFrame, text: str, keywords: list[str], least: int) -> DataFrame:
    """Rows with at least `least` distinct keywords among their tokens, and which ones."""
    hits = F.array_intersect(F.array(*[F.lit(k) for k in keywords]), tokens(F.col(text)))
    return df.withColumn("hits", hits).where(F.size("hits") >= least)


def roles_with_fallback(docs: DataFrame, key: str, bucket: str, text: str, roles: DataFrame, n: int) -> DataFrame:
    """(key, role, matched): roles of the bucket whose term is a token of the text; else the bucket's first n."""
    docs = dealt(docs, key, MOST_DOCS)
    roles = small(roles.distinct())
    words = docs.select(key, bucket, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    hits = words.join(roles, [bucket, "term"]).select(key, "role").distinct().withColumn("matched", F.lit(True))
    first = top_per_key(roles.select(bucket, "role").distinct(), [bucket], [F.col("role")], n).drop("rank")
    rest = docs.select(key, bucket).join(hits.select(key).distinct(), key, "left_anti")
    return hits.unionByName(rest.join(first, bucket).select(key, "role", F.lit(False).alias("matched")))


def relevant(junk: Column, has_terms: Column, strong: Column, ambiguous: Column, context: Column) -> Column:
    """Junk and rows without terms go; a strong term passes; an ambiguous one needs context."""
    return ~junk & has_terms & (strong | (ambiguous & context))


def generated_aliases(name: Column, generic: list[str], synonyms: dict[str, str], stored: Column | None = None) -> Column:
    """The name, its words without generic nouns in their order, its words with synonyms put in, and stored aliases."""
    words = F.split(F.lower(name), " ")
    kept = F.array_join(F.filter(words, lambda w: ~w.isin(generic)), " ")
    swap = lambda w: reduce(lambda a, kv: F.when(w == kv[0], kv[1]).otherwise(a), synonyms.items(), w)
    swapped = F.array_join(F.transform(words, swap), " ")
    made = F.array_distinct(F.filter(F.array(F.lower(name), kept, swapped), lambda x: x != ""))
    return made if stored is None else F.array_union(made, F.transform(F.coalesce(stored, F.array()), lambda a: F.lower(a)))


def term_budget(df: DataFrame, key: str, items: str, head: float, rest: float) -> DataFrame:
    """(key, term, weight): the first item gets head, the others share rest by 1 / rank; a later entry of the same
    term overwrites an earlier one."""
    each = df.select(key, F.posexplode(items).alias("p", "term"))
    share = F.sum(F.when(F.col("p") > 0, 1 / F.col("p"))).over(Window.partitionBy(key))
    weighed = each.withColumn("w", F.when(F.col("p") == 0, head).otherwise(rest / F.col("p") / share))
    return weighed.groupBy(key, "term").agg(F.max_by("w", "p").alias("weight"))


def first_available(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first part that has the key."""
    marked = [p.withColumn("__tier", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b), marked)
    least = F.min("__tier").over(Window.partitionBy(*keys))
    return both.withColumn("__least", least).where("__tier = __least").drop("__tier", "__least")


def jaccard_matches(left: DataFrame, key: str, right: DataFrame, other: str, item: str, targets: DataFrame | None = None) -> DataFrame:
    """(key, other, overlap, share): items in common, over the other's size.  left, right: (key, item), (other, item).

    targets: (key, target); a key whose target is, or stands in, the name of an other gets only the first such
    one, by name, whatever they share.
    """
    size = right.groupBy(other).agg(F.count_distinct(item).alias("__size"))
    pairs = dealt(cut(left.select(key, item), "jaccard"), key, MOST_PAIRS).distinct()
    both = pairs.join(small(right.select(other, item).distinct()), item).groupBy(key, other).agg(F.count("*").alias("overlap"))
    if targets is not None:
        low, name = F.lower("target"), F.lower(other)
        aimed = targets.join(small(size.select(other)), F.contains(name, low)).groupBy(key).agg(F.min(F.struct((name != low).alias("__far"), other)).alias("__f"))
        aimed = aimed.select(key, F.col("__f")[other].alias(other))
        free = both.join(aimed, key, "left_anti")
        both = free.unionByName(aimed.join(both, [key, other], "left").select(key, other, F.coalesce("overlap", F.lit(0)).alias("overlap")))
    return both.join(size, other).select(key, other, "overlap", F.round(F.col("overlap") / F.col("__size"), 6).alias("share"))


def token_accuracy(df: DataFrame, gold: str, found: str, outside: str, ignore: str) -> DataFrame:
    pairs = df.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(found).alias("f"))).alias("p")).select("p.g", "p.f")
    seen = pairs.where(F.col("g") != ignore)
    right = (F.col("g") == F.col("f")).cast("double")
    return seen.agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("g") != outside, right)), 6).alias("labelled"))


def running_coverage_cost(df: DataFrame, group: str, order: list[Column], provider: Column, known: Column) -> DataFrame:
    """quality: provider score, whether the level is known, and one over the resource's running number."""
    seen = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    quality = 0.55 * provider + 0.25 * F.when(known, 1.0).otherwise(0.6) + 0.20 * F.least(F.lit(1.0), 1 / seen)
    return df.withColumn("quality", F.round(quality, 6))


def role_total(sem: Column, cov: Column, res: Column, graph: Column, miss: Column, prereq: Column, hours: Column, digits: int = 4) -> Column:
    h = F.least(F.lit(1.0), hours / 320)
    x = 0.42 * sem + 0.23 * cov + 0.10 * res + 0.08 * graph - 0.19 * miss - 0.15 * prereq - 0.09 * h
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), digits)


def path_score(cov: Column, res: Column, graph: Column, prereq: Column, hours: Column, digits: int = 4) -> Column:
    """How good a learning path is: .45 coverage, .30 resources, .25 graph, less .20 prerequisites and .15 hours (of 320)."""
    h = F.least(F.lit(1.0), hours / 320)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * cov + 0.30 * res + 0.25 * graph - 0.20 * prereq - 0.15 * h)), digits)


def path_analysis(asked: DataFrame, user: str, role: str, targets: DataFrame, known: DataFrame, skills: DataFrame, depths: DataFrame, hours: DataFrame) -> DataFrame:
    """(user, role, coverage, missing, prerequisite, resource, graph, hours, role_score, path_score) of each pair asked for.

    Shares of importance: of the role's skills that the user knows, lacks, lacks by difficulty, level and depth, and lacks by
    how well they are taught and connected.  Nothing lacking: the graph's share is 1.

    asked: user, role, semantic; targets: role, skill, importance; known: user, skill; skills: skill, difficulty (1 to 3), level,
    teaches, graph; depths: user, skill, depth (1 where there is none); hours: user, role, hours.
    """
    rows = asked.select(user, role, "semantic").join(targets, role).join(known.select(user, "skill").distinct().withColumn("__known", F.lit(True)), [user, "skill"], "left")
    rows = rows.join(skills, "skill", "left").join(depths, [user, "skill"], "left")
    lacks, w = F.col("__known").isNull(), F.col("importance")
    hard = 0.45 * F.coalesce("difficulty", F.lit(2.0)) / 3.0 + 0.35 * F.coalesce("level", F.lit(1)) / 5.0 + 0.20 * F.least(F.greatest(F.coalesce("depth", F.lit(1)), F.lit(1)) / 6.0, F.lit(1.0))
    part = lambda x: F.sum(F.when(lacks, w * x).otherwise(0.0))
    sums = rows.groupBy(user, role).agg(
        F.first("semantic").alias("semantic"), F.greatest(F.sum(w), F.lit(1e-8)).alias("__w"), F.sum(F.when(lacks, 0.0).otherwise(w)).alias("coverage"), part(F.lit(1.0)).alias("missing"),
        part(F.least(F.lit(1.0), hard)).alias("prerequisite"), part(F.coalesce("teaches", F.lit(0.0))).alias("resource"), part(F.coalesce("graph", F.lit(0.45))).alias("graph"),
    )
    shares = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col("__w"))) for c in ("coverage", "missing", "prerequisite", "resource", "graph")}
    shares["graph"] = F.when(F.col("missing") == 0, 1.0).otherwise(shares["graph"])
    out = sums.select(user, role, "semantic", *[x.alias(c) for c, x in shares.items()]).join(hours, [user, role], "left").withColumn("hours", F.coalesce("hours", F.lit(0)))
    c = {x: F.col(x) for x in ("coverage", "missing", "prerequisite", "resource", "graph", "hours")}
    whole = role_total(F.col("semantic"), c["coverage"], c["resource"], c["graph"], c["missing"], c["prerequisite"], c["hours"])
    path = path_score(c["coverage"], c["resource"], c["graph"], c["prerequisite"], c["hours"])
    return out.select(user, role, *[F.round(x, 6).alias(n) for n, x in c.items()], whole.alias("role_score"), path.alias("path_score"))


def compact_rows(rows: DataFrame, key: str, skills: DataFrame, steps: DataFrame, resources: DataFrame, most=(12, 8, 2)) -> DataFrame:
    """One row for each key: its first 12 skills, and its first 8 steps with 2 resources each.

    skills: key, place, skill; steps: key, place, step; resources: step, place, resource.
    """
    n_skills, n_steps, n_resources = most

    def lists(df: DataFrame, keys: list[str], column: str, n: int, name: str) -> DataFrame:
        top = top_per_key(df, keys, [F.col("place"), F.col(column)], n)
        value = F.struct("rank", column) if name != "steps" else F.struct("rank", column, "resources")
        return top.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))

    held = lists(resources, ["step"], "resource", n_resources, "resources")
    held = held.select("step", F.transform("resources", lambda x: x["resource"]).alias("resources"))
    walked = top_per_key(steps, [key], [F.col("place"), F.col("step")], n_steps).drop("rank").join(held, "step", "left")
    walked = lists(walked.withColumn("resources", F.coalesce("resources", F.array())), [key], "step", n_steps, "steps")
    walked = walked.select(key, F.transform("steps", lambda x: F.struct(x["step"].alias("step"), x["resources"].alias("resources"))).alias("steps"))
    named = lists(skills, [key], "skill", n_skills, "skills").select(key, F.transform("skills", lambda x: x["skill"]).alias("skills"))
    return rows.select(key).distinct().join(named, key, "left").join(walked, key, "left")
