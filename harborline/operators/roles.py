"""Roles met with postings, documents and queries: candidates, match scores, attribution and name resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators.matching import contained_terms, marked, tokens, usable_skills
from harborline.operators.relational import MOST_DOCS, dealt, small, top_per_key

#: Words of titles that tell no role, and what belongs to a word.
TITLE_STOPWORDS = (
    "engineer", "developer", "architect", "specialist", "administrator", "admin", "consultant",
    "manager", "lead", "senior", "junior", "middle", "staff", "principal", "sr", "jr",
)
TITLE_TOKENS = "[a-z0-9+#.]+"
TEXT_LENGTH = 4000


def array_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def title_words(text: Column, stop=TITLE_STOPWORDS) -> Column:
    """Distinct words of a title that may tell its role; dots, pluses and hashes belong to words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TITLE_TOKENS), F.lit(0))), array_of(stop))


def matched_candidates(postings: DataFrame, key: str, title: str, roles: DataFrame, name: str, aliases: str) -> DataFrame:
    """(key, name): roles that share a word of the title with their name or an alias, stand in it, or have an alias in it.

    Words meet by an equal join, names and aliases through an inverted index.
    """
    asked = postings.select(key, title)
    words = asked.select(key, F.explode(title_words(F.col(title))).alias("__w"))
    own = F.array_union(title_words(F.col(name)), F.flatten(F.transform(F.coalesce(aliases, array_of([])), lambda a: title_words(a))))
    shared = words.join(small(roles.select(name, F.explode(F.array_distinct(own)).alias("__w"))), "__w").select(key, name)
    inside = contained_terms(asked, key, title, roles, name, bounded=False)
    listed = roles.select(name, F.explode(aliases).alias("__alias")).distinct()
    by_alias = contained_terms(asked, key, title, listed, "__alias").join(small(listed), "__alias").select(key, name)
    return shared.unionByName(inside).unionByName(by_alias).distinct()


def role_candidates(postings: DataFrame, key: str, title: str, roles: DataFrame, name: str, aliases: str) -> DataFrame:
    """matched_candidates(), and every role for postings without any: that product is the result asked for."""
    found = matched_candidates(postings, key, title, roles, name, aliases)
    rest = postings.select(key).join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(rest.join(small(roles.select(name))))


def scored_roles(
    postings: DataFrame, key: str, title: str, text: str, roles: DataFrame, name: str, aliases: str, skills: str, generic: str,
    ambiguous=(), support=(), stop=TITLE_STOPWORDS,
) -> DataFrame:
    """(key, name, score, by, held): candidates with a score over 0, and the skills that the posting holds.

    A posting without candidates may take any role, but only skills in its title can score there: it meets those
    roles that have one, so no posting meets every role.
    """
    taxonomy = roles.select(
        F.col(name), title_words(F.col(name), stop).alias("__rw"), F.lower(name).alias("__low"), F.col(generic).alias("__generic"),
        F.transform(F.filter(F.coalesce(aliases, array_of([])), lambda a: F.trim(a) != ""), lambda a: marked(F.trim(a))).alias("__al"),
        F.transform(usable_skills(F.slice(F.coalesce(skills, array_of([])), 1, 10), ambiguous), lambda s: F.struct(s.alias("s"), marked(s).alias("m"))).alias("__sk"),
    )
    found = matched_candidates(postings, key, title, roles, name, aliases)
    rest = postings.select(key, title).join(found.select(key).distinct(), key, "left_anti")
    listed = taxonomy.select(name, F.explode("__sk.s").alias("__skill")).distinct()
    by_skill = contained_terms(rest, key, title, listed, "__skill").join(small(listed), "__skill").select(key, name).distinct()
    low = F.lower(F.coalesce(title, F.lit("")))
    body = F.lower(F.coalesce(F.substring(text, 1, TEXT_LENGTH), F.lit("")))
    said = postings.select(key, title_words(low, stop).alias("__tw"), low.alias("__title"), F.concat(low, F.lit("\n"), body).alias("__both"))
    said = said.withColumn("__mt", marked(F.col("__title"))).withColumn("__mb", marked(F.col("__both")))
    pairs = found.unionByName(by_skill).join(said, key).join(small(taxonomy), name)
    pairs = pairs.withColumn("__held", F.filter("__sk", lambda s: F.contains("__mb", s["m"]))).withColumn("__named", F.filter("__sk", lambda s: F.contains("__mt", s["m"])))
    pairs = pairs.withColumn("__alias", F.exists("__al", lambda a: F.contains("__mt", a)))
    return pairs.withColumn("m", role_match(support)).where(F.col("m.score") > 0).select(key, name, "m.score", "m.by", F.col("__held.s").alias("held"))


def role_match(support=()) -> Column:
    """Struct (score, by) of a pair as scored_roles() prepares it: how well a posting fits a role, and by what ("title", "alias",
    "skill", "mixed", "none").

    By the title: 1 for the role within it; .55 + .35 of the share of shared words, two at least and half of
    the role's; .65 for a role of one word.  An alias in it: .92 at least.  Skills add to either, or alone
    decide where the title holds some of them.  A generic role needs a skill or a support word in the
    posting, and by skills alone a shared word.
    """
    shared, size = F.size(F.array_intersect("__rw", "__tw")), F.size("__rw")
    share = shared / F.greatest(size, F.lit(1))
    by_title = (
        F.when(F.contains("__title", F.col("__low")), 1.0)
        .when((size >= 2) & (shared >= 2) & (share >= 0.5), F.round(0.55 + 0.35 * share, 6))
        .when((size == 1) & (shared == 1), 0.65)
        .otherwise(0.0)
    )
    by_alias, held, named = F.col("__alias"), F.size("__held"), F.size("__named")
    part = lambda x: F.round(x / F.greatest(F.size("__sk"), F.lit(1)), 6)
    h, t = part(held), part(named)
    strong = (named >= 2) | (t >= 0.2)
    some = (named >= 1) & (t >= 0.1)
    matched = (by_title > 0) | by_alias
    base = F.greatest(by_title, F.when(by_alias, 0.92).otherwise(0.0))
    alone = ~matched & ((strong & (held >= 2) & (h >= 0.2)) | (some & (held >= 3) & (h >= 0.35)))
    score = (
        F.when(alone, F.least(F.lit(0.78), 0.2 + 0.58 * h) + F.when(strong, 0.08).otherwise(0.04))
        .when(matched & (h > 0), F.greatest(base, F.least(F.lit(1.2), base + 0.15 + 0.35 * h)))
        .otherwise(base)
    )
    by = (
        F.when(alone, "skill").when(matched & (h > 0), "mixed").when((by_title > 0) & by_alias, "mixed")
        .when(by_alias, "alias").when(by_title > 0, "title").otherwise("none")
    )
    backed = reduce(lambda a, w: a | F.contains("__both", F.lit(w)), support, held > 0)
    out = F.col("__generic") & ((by.isin("title", "alias") & ~backed) | ((by == "skill") & (shared == 0)))
    return F.struct(F.when(out, 0.0).otherwise(F.round(score, 6)).alias("score"), F.when(out, "none").otherwise(by).alias("by"))


def best_role(scored: DataFrame, key: str, name: str, score: str, by: str, least: float = 0.45, by_skill: float = 0.6) -> DataFrame:
    """The best role of each key: by score, title matches first, then by name; too weak ones are left out."""
    order = [F.col(score).desc(), (F.col(by) == "title").desc(), F.col(name)]
    best = top_per_key(scored.where(F.col(score) > 0), [key], order, 1).drop("rank")
    return best.where((F.col(score) >= least) & ((F.col(by) != "skill") | (F.col(score) >= by_skill)))


def matched_postings(postings: DataFrame, key: str, month: str, scored: DataFrame, name: str) -> DataFrame:
    """postings with the best role of scored_roles(), its score, by and held skills; those without a month or a good
    enough role are left out."""
    best = best_role(scored, key, name, "score", "by")
    return postings.where(F.col(month).isNotNull()).join(best, key)


def substring_attribution(docs: DataFrame, key: str, buckets: str, text: str, terms: DataFrame, shortest: int = 4) -> DataFrame:
    """(key, bucket, role, weight): in each of a document's buckets, the role's distinct terms within the text,
    over those of all roles; a document in k buckets contributes k units.

    terms: bucket, role, term; a term of fewer than `shortest` characters does not count.  Each document
    meets only the terms of its buckets.
    """
    listed = small(terms.where(F.length("term") >= shortest).select("bucket", "role", F.lower("term").alias("term")).distinct())
    each = dealt(docs.select(key, buckets, text), key, MOST_DOCS).select(key, F.lower(text).alias("__t"), F.explode(F.array_distinct(buckets)).alias("bucket"))
    hits = each.join(listed, "bucket").where(F.contains("__t", F.col("term"))).groupBy(key, "bucket", "role").agg(F.count("*").alias("n"))
    return hits.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy(key, "bucket"))).drop("n")


def resolved_names(asked: DataFrame, name: str, roles: DataFrame, role: str, aliases: str, order: str) -> DataFrame:
    """asked and the role: the first, by order, whose name, hyphenated name or alias it is, case aside; else null."""
    forms = F.array_union(F.array(F.lower(role), F.lower(F.regexp_replace(role, " ", "-"))), F.transform(aliases, lambda a: F.lower(a)))
    table = roles.select(F.explode(forms).alias("__form"), role, order).groupBy("__form").agg(F.min_by(role, order).alias(role))
    return asked.withColumn("__form", F.lower(F.trim(name))).join(table, "__form", "left").drop("__form")


def first_in_catalog(asked: DataFrame, query: str, catalog: DataFrame, id_: str, fine: str, name: str, order: str) -> DataFrame:
    """(query, id): the first catalog row, by order, whose fine name holds the query; else whose name holds it; else null."""
    q = small(asked.select(query).distinct())
    low = F.lower(F.trim(query))
    on_fine, on_name = F.contains(F.lower(fine), low), F.contains(F.lower(name), low)
    hits = catalog.join(q, (on_fine | on_name) & (low != "")).withColumn("__tier", F.when(on_fine, 0).otherwise(1))
    best = hits.groupBy(query).agg(F.min_by(id_, F.struct("__tier", order)).alias(id_))
    return asked.join(best, query, "left")


def focused_or_all(roles: DataFrame, name: str, aliases: str, skills: str, hints: list[str], least: int = 2) -> DataFrame:
    """Roles with a hint in name or alias, or in `least` skills; all roles if there is none.  Hints are plain substrings."""
    has = lambda c: reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(h)) for h in hints])
    good = has(F.col(name)) | F.exists(aliases, has) | (F.size(F.filter(skills, has)) >= least)
    marked = roles.withColumn("__good", good)
    any_good = marked.agg(F.coalesce(F.bool_or("__good"), F.lit(False)).alias("__any"))  # one row
    return marked.crossJoin(F.broadcast(any_good)).where(F.col("__good") | ~F.col("__any")).drop("__good", "__any")


def curated_aliases(entities: DataFrame, key: str, name: str, aliases: str, common: DataFrame, most_owners: int = 3, n: int = 4) -> DataFrame:
    """(key, aliases): aliases in their order, case aside distinct, but the own name, single words, `common` ones
    (column alias) and those of more than most_owners entities; n at most."""
    each = entities.select(key, F.lower(name).alias("__own"), F.posexplode(aliases).alias("__p", "__a")).withColumn("alias", F.lower(F.trim("__a")))
    each = each.where((F.col("alias") != F.col("__own")) & F.contains("alias", F.lit(" ")))
    shared = each.groupBy("alias").agg(F.count_distinct(key).alias("__owners")).where(F.col("__owners") <= most_owners)
    kept = each.join(shared, "alias", "left_semi").join(common.select(F.lower("alias").alias("alias")), "alias", "left_anti")
    once = kept.groupBy(key, "alias").agg(F.min(F.struct("__p", "__a")).alias("__f"))
    top = top_per_key(once, [key], [F.col("__f")], n)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__f"))), lambda x: x["__f"]["__a"]).alias("aliases"))


def events_by_keywords(events: DataFrame, key: str, text: str, entities: DataFrame, entity: str, keyword: str, least: int, order: list[Column], n: int) -> DataFrame:
    """The first n events of each entity with `least` of its keywords among the words of the text."""
    events = dealt(events, key, MOST_DOCS // 10)
    words = events.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("__w"))
    wanted = entities.select(entity, F.lower(keyword).alias("__w")).distinct()
    hits = words.join(wanted, "__w").groupBy(key, entity).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    return top_per_key(hits.join(events, key), [entity], order, n)


def loosely_related(df: DataFrame, text: str, roles: DataFrame, name: str, aliases: str, skills: str, soft: list[str], least: int = 2) -> DataFrame:
    """Rows whose text holds a role's name, one of its first 5 aliases or first 6 skills, or `least` soft keywords;
    all as plain substrings, case aside."""
    terms = roles.select(F.explode(F.concat(F.array(name), F.slice(aliases, 1, 5), F.slice(skills, 1, 6))).alias("__term"))
    terms = small(terms.select(F.lower("__term").alias("__term")).where(F.col("__term") != "").distinct())
    low = F.lower(text)
    hits = reduce(lambda a, w: a + F.contains(low, F.lit(w)).cast("int"), soft, F.lit(0))
    plain = df.where(hits >= least)
    return plain.unionByName(df.where(F.coalesce(hits < least, F.lit(True))).join(terms, F.contains(low, F.col("__term")), "left_semi"))
