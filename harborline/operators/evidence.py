"""Evidence for trends: aggregates over all candidates, picked events with a counter-signal, citations, notes.

A group (a role) may hold a third of all rows.  What needs a whole group is an aggregate joined back; what
ranks is limited within each (group, tier, impact) before the shuffle, so that the windows see a few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators.aggregates import top_values
from harborline.operators.relational import small, top_per_key
from harborline.operators.retrieval import first_by_url_then_title

#: Themes that tell nothing of a trend; the least articles; tones that count as an impact.
PLAIN_THEMES = ("TAX_", "UNGP_", "CRISISLEX")
FEW_ARTICLES = 20
BAND = 1.0


def impact_of(tone: Column, band: float = BAND) -> Column:
    return F.when(tone > band, "positive").when(tone < -band, "negative").otherwise("neutral")


def evidence_aggregate(rows: DataFrame, group: str, tone: str, themes: str, domain: str, economic: list[str], skipped=PLAIN_THEMES) -> DataFrame:
    """(group, articles, mean_tone, positive, opportunities, risks, net, themes, domains).

    themes: one string, parted by semicolons.  An opportunity has an economic theme and a tone above 0, a risk
    one below; net tells which are more.  The six most frequent themes but skipped prefixes, and the five
    most frequent domains, ties by name.
    """
    upper, t = F.upper(F.coalesce(F.col(themes), F.lit(""))), F.coalesce(F.col(tone), F.lit(0.0))
    econ = reduce(lambda a, b: a | b, [F.contains(upper, F.lit(e)) for e in economic])
    g = rows.groupBy(group).agg(
        F.count("*").alias("articles"), F.round(F.avg(t), 3).alias("mean_tone"), F.round(F.avg((t > 0).cast("double")), 3).alias("positive"),
        F.count_if(econ & (t > 0)).alias("opportunities"), F.count_if(econ & (t < 0)).alias("risks"),
    )
    up, down = F.col("opportunities"), F.col("risks")
    g = g.withColumn("net", F.when(up > down, "positive").when(down > up, "negative").otherwise("mixed"))
    each = rows.select(group, F.explode(F.split(F.coalesce(themes, F.lit("")), ";")).alias("theme")).withColumn("theme", F.trim("theme"))
    each = each.where((F.col("theme") != "") & ~reduce(lambda a, p: a | F.startswith("theme", F.lit(p)), skipped, F.lit(False)))
    g = g.join(top_values(each, [group], "theme", 6, "themes"), group, "left").join(top_values(rows, [group], domain, 5, "domains"), group, "left")
    return g.withColumn("themes", F.coalesce("themes", F.array().cast("array<string>")))


def picked_events(
    df: DataFrame, group: str, want: str, impact: str, affinity: str, quality: str, order: list[Column], k: int, strong: float = 0.5, weak: float = 0.5
) -> DataFrame:
    """At most k rows of each group with place and weak.

    Rows of the wanted impact ("positive", "negative" or null) come first, then by order.  Only rows of enough
    affinity are taken; a group without any takes those of enough quality, as weak.  If an impact is wanted,
    k is 3 or more and no row taken is against it, the last gives way to the best that is, among the strong
    rows, or among all where there are none.
    """
    tier = F.when(F.col(affinity) >= strong, 0).when(F.col(quality) >= weak, 1).otherwise(2)
    few = top_per_key(df.withColumn("__tier", tier), [group, "__tier", impact], order, k).drop("rank")
    w = Window.partitionBy(group)
    any_strong = F.min("__tier").over(w) == 0
    few = few.withColumn("weak", ~any_strong)
    few = few.withColumn("__in", F.when(F.col("weak"), F.col("__tier") == 1).otherwise(F.col("__tier") == 0))
    wanted = F.coalesce(F.col(impact) == F.col(want), F.lit(False))
    few = few.withColumn("place", F.row_number().over(w.orderBy(F.col("__in").desc(), wanted.desc(), *order)))
    few = few.withColumn("__taken", F.col("__in") & (F.col("place") <= k))
    counter = F.when(F.col(want) == "positive", "negative").when(F.col(want) == "negative", "positive")
    few = few.withColumn("__against", F.coalesce(F.col(impact) == counter, F.lit(False)) & (F.col("weak") | (F.col("__tier") == 0)))
    few = few.withColumn("__best", (F.row_number().over(w.orderBy(F.col("__against").desc(), *order)) == 1) & F.col("__against"))
    few = few.withColumn("__last", F.max(F.when(F.col("__taken"), F.col("place"))).over(w))
    held = F.max((F.col("__taken") & F.coalesce(F.col(impact) == counter, F.lit(False))).cast("int")).over(w) == 0
    swap = held & (F.max(F.col("__best").cast("int")).over(w) == 1) & F.col("__last").isNotNull() & F.lit(k >= 3)
    few = few.withColumn("__swap", swap)
    keep = F.when(F.col("__swap"), (F.col("__taken") & (F.col("place") < F.col("__last"))) | F.col("__best")).otherwise(F.col("__taken"))
    place = F.when(F.col("__swap") & F.col("__best"), F.col("__last")).otherwise(F.col("place"))
    kept = few.where(keep).withColumn("place", place)
    return kept.withColumn("weak", F.col("weak") & (F.col("__tier") == 1)).drop("__tier", "__in", "__taken", "__against", "__best", "__last", "__swap")


def batch_evidence(
    asked: DataFrame, group: str, candidates: DataFrame, gate: Column, aggregates: DataFrame, ranked, precomputed: DataFrame, key: str, order: list[Column], k: int = 5
) -> DataFrame:
    """(group, direction used, place, key, weak, source) for every asked (group, direction), in one job.

    aggregates are of all candidates (evidence_aggregate); events come from those that pass the gate, scored by
    ranked(rows) and rid of repeated URLs and titles (url, title).  A flat or missing direction takes the
    aggregate's sign.  Groups without candidates get precomputed rows (group, key, place).  Candidates:
    impact, affinity, quality, url, title.
    """
    net = asked.join(aggregates.select(group, "net"), group, "left")
    flat = F.coalesce(F.col("direction").isin("flat", "stable"), F.lit(True))
    used = F.when(flat & (F.col("net") == "positive"), "up").when(flat & (F.col("net") == "negative"), "down").otherwise(F.col("direction"))
    net = net.select(group, used.alias("direction"), F.when(used == "up", "positive").when(used == "down", "negative").alias("__want"), F.col("net").isNull().alias("__none"))
    once = first_by_url_then_title(ranked(candidates.where(gate)), group, "url", "title", order)
    events = picked_events(once.join(small(net.where(~F.col("__none"))), group), group, "__want", "impact", "affinity", "quality", order, k)
    events = events.select(group, "direction", "place", key, "weak", F.lit("events").alias("source"))
    rest = net.where("__none").join(precomputed.where(F.col("place") <= k), group)
    return events.unionByName(rest.select(group, "direction", "place", key, F.lit(False).alias("weak"), F.lit("precomputed").alias("source")))


def major_events(conclusions: DataFrame, role: str, direction: str, category: str, catalog: DataFrame, mapping: DataFrame, n: int = 5) -> DataFrame:
    """(role, direction, place, event): the events mapped to the role and direction (role, direction, event, place);
    where there are none, the n most important of the role's category that fit the direction.

    catalog: event, categories, fits (arrays), importance; "stable" counts as "flat".
    """
    asked = conclusions.select(role, F.when(F.col(direction) == "stable", "flat").otherwise(F.col(direction)).alias(direction), category).distinct()
    mapped = asked.join(mapping.select(role, direction, "event", "place"), [role, direction])
    named = mapped.join(catalog.select("event"), "event", "left_semi")
    named = named.select(role, direction, "place", "event")
    rest = asked.join(mapped.select(role, direction).distinct(), [role, direction], "left_anti")
    fitting = catalog.select("event", "importance", F.explode("categories").alias(category), "fits").select("event", "importance", category, F.explode("fits").alias(direction))
    best = top_per_key(fitting.distinct(), [category, direction], [F.col("importance").desc(), F.col("event")], n)
    return named.unionByName(rest.join(best, [category, direction]).select(role, direction, F.col("rank").alias("place"), "event"))


def assembled(conclusions: DataFrame, keys: list[str], parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Conclusions with a list from each part: name -> (keys, place, column); rows of a part are few for each key."""
    out = conclusions
    for name, (rows, column) in parts.items():
        lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.col(column).alias("v")))).alias(name))
        lists = lists.withColumn(name, F.transform(name, lambda x: x["v"]))
        out = out.join(lists, keys, "left")
    return out


def cited(parts: dict[str, tuple[DataFrame, str, list[Column], int]], key: str) -> DataFrame:
    """(key, cite, value): numbered marks, as E1, E2, M1; parts: mark -> (rows, value column, order, at most)."""
    out = None
    for mark, (rows, value, order, n) in parts.items():
        top = top_per_key(rows, [key], order, n)
        mine = top.select(key, F.concat(F.lit(mark), F.col("rank")).alias("cite"), F.col(value).cast("string").alias("value"))
        out = mine if out is None else out.unionByName(mine)
    return out


def risk_notes(direction: Column, net: Column, articles: Column, events: Column, weak: Column) -> Column:
    """Flags of a conclusion: its sign against the aggregate's, few articles, weak events, no event."""
    against = ((direction == "up") & (net == "negative")) | ((direction == "down") & (net == "positive"))
    return F.array_compact(
        F.array(
            F.when(against, "against_aggregate"), F.when(articles < FEW_ARTICLES, "few_articles"),
            F.when(weak > 0, "weak_events"), F.when(F.coalesce(events, F.lit(0)) == 0, "no_event"),
        )
    )
