"""Joins, merges, sorts and set operations as they are used by the trend and matching plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.sources.scratch import cut

#: Rows up to which a side may be broadcast.
MOST_BROADCAST = 100_000
#: Documents about which a task takes where each meets many terms or roles.
MOST_DOCS = 50_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df to be broadcast if it was counted to have at most `most` rows; else as it is, for Spark to join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, key: str, most: int) -> DataFrame:
    """df by key in counted tasks of about `most` rows: what then grows by a bounded factor and is grouped by the key and
    more stays in these tasks, whose size does not depend on the input's or its files'."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
    return df.repartition(tasks, key)


def outer_merge(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Chained full outer joins on keys; missing numbers become 0."""
    merged = reduce(lambda a, b: a.join(b, keys, "full_outer"), sources)
    return merged.fillna(0)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys of which nulls are equal."""
    renamed = right.select(*[F.col(k).alias(f"__right_{k}") if k in keys else F.col(k) for k in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def grouped_quantile(rows: DataFrame, keys: list[str], value: str, p: float = 0.5, name: str = "quantile") -> DataFrame:
    """(keys, name): the exact quantile of each group's values, linear between ranks; groups without a value have no row.

    Equal values are counted first; the distinct ones are sorted by range and written, and what crosses ranges is one
    count for each group in each of them.  So no task gathers a group, and no value weighs more than a row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    lane = F.monotonically_increasing_id()
    dealt = counted.repartitionByRange(*keys, "__v").sortWithinPartitions(*keys, "__v")
    dealt = cut(dealt.withColumn("__lane", F.shiftright(lane, 33)).withColumn("__at", lane), "quantile")
    within = Window.partitionBy("__lane", *keys).orderBy("__at")
    lanes = dealt.groupBy("__lane", *keys).agg(F.sum("__c").alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    lanes = lanes.select("__lane", *keys, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__all"))
    placed = null_safe(dealt.withColumn("__to", F.sum("__c").over(within)), small(lanes), ["__lane", *keys])
    place, last = F.lit(p) * (F.col("__all") - 1), F.col("__before") + F.col("__to") - 1
    covers = lambda rank: (rank <= last) & (rank > last - F.col("__c"))
    low, high = F.floor(place), F.ceil(place)
    ends = placed.where(covers(low) | covers(high)).groupBy(*keys).agg(
        F.max(F.when(covers(low), F.col("__v"))).alias("__l"), F.max(F.when(covers(high), F.col("__v"))).alias("__h"), F.max(place - low).alias("__s")
    )
    return ends.select(*keys, (F.col("__l") + (F.col("__h") - F.col("__l")) * F.col("__s")).alias(name))


def left_or_zero(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    added = [c for c in other.columns if c not in keys]
    return base.join(other, keys, "left").fillna(0, added)


def month_grid(names: DataFrame, low: Column, high: Column) -> DataFrame:
    """Every name with every month from low to high (first days of months); a bounded sequence per name."""
    return names.withColumn("month", F.explode(F.sequence(low, high, F.expr("interval 1 month"))))


def only_in_first(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def with_both_ends(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select(node).distinct()
    there = edges.join(ids.withColumnRenamed(node, src), src, "left_semi")
    return there.join(ids.withColumnRenamed(node, dst), dst, "left_semi")


def expand_keys(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """One row for each value that the key maps to (mapping: key, values array)."""
    return rows.join(mapping.select(key, F.explode("values").alias("value")), key)


def pairwise_slopes(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, slope) of all ordered pairs of points; at: an integer place.  Series are bounded by their grid."""
    a = series.select(key, F.col(at).alias("i"), F.col(value).alias("x"))
    b = series.select(key, F.col(at).alias("j"), F.col(value).alias("y"))
    return a.join(b, key).where("i < j").select(key, ((F.col("y") - F.col("x")) / (F.col("j") - F.col("i"))).alias("slope"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in a total order; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def upsert(base: DataFrame, update: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Update rows replace base rows of equal keys; of several updates the first in order wins."""
    latest = top_per_key(update, keys, order, 1).drop("rank")
    return base.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*base.columns))


def coalescing_upsert(base: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """New values replace old ones, but null keeps the old; rows of either side stay."""
    values = [c for c in base.columns if c not in keys]
    renamed = update.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in values])
    joined = base.join(renamed, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"__new_{c}", c).alias(c) for c in values])


def replace_source(base: DataFrame, new: DataFrame, column: str, source: str) -> DataFrame:
    return base.where(~F.col(column).eqNullSafe(source)).unionByName(new)


def rebuild_measure(base: DataFrame, new: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """The measure comes from new alone; other measures stay; keys only in new get null for them."""
    others = [c for c in base.columns if c not in keys and c != measure]
    return base.drop(measure).join(new.select(*keys, measure), keys, "full_outer").select(*keys, *others, measure)


def capped_sample(df: DataFrame, key: str, n: int, by: list[str]) -> DataFrame:
    """n rows of each group by the order of the key's digest: the same rows in every run."""
    return top_per_key(df, by, [F.md5(F.col(key).cast("string")), F.col(key)], n).drop("rank")


def renumbered(df: DataFrame, order: list[Column], prefix: str, width: int) -> DataFrame:
    """Add id: prefix and the row's place in a total order.

    Places come from a range sort: counts of its partitions, then places within them; no single partition.
    The sorted rows are written first: range bounds are sampled, so a second evaluation would deal otherwise.
    """
    lane = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("__lane", F.shiftright(lane, 33)).withColumn("__at", lane.bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = cut(dealt, "renumbered")
    counts = dealt.groupBy("__lane").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("__lane", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    placed = dealt.join(F.broadcast(starts), "__lane")
    number = (F.col("__start") + F.col("__at") + 1).cast("string")
    return placed.withColumn("id", F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(width), F.length(number)), "0"))).drop("__lane", "__at", "__start")


def melted(df: DataFrame, keys: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)
