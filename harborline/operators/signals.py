"""Trend service rows: supplemental signals by source, forecast summaries, batch signals, metric evidence, sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators.relational import renumbered
from harborline.operators.series import direction_by_level, latest, recent_summary, robust_direction, robust_trend, smoothed, turning_points

#: A source needs so many observed months, the newest of them at most so old.
LEAST_MONTHS, OLDEST = 2, 6

#: measure column -> (weight, on a log scale, only if it is not all zero)
Measures = dict[str, tuple[float, bool, bool]]


def temporal_split(windows: DataFrame, key: str, start: str, first: int) -> DataFrame:
    """Add part: windows that start at `first` or later are for validation; if that leaves a side empty, the last
    fifth by start and key, one at least."""
    late = F.col(start) >= first
    n, held = windows.agg(F.count("*"), F.count_if(late)).first()
    if 0 < held < n:
        return windows.withColumn("part", F.when(late, "validation").otherwise("train"))
    placed = renumbered(windows, [F.col(start), F.col(key)], "", 1)
    last = F.col("id").cast("long") > n - max(1, n // 5)
    return placed.withColumn("part", F.when(last, "validation").otherwise("train")).drop("id")


def source_signals(panel: DataFrame, key: str, at: str, origin: Column, sources: dict[str, tuple[str, float, Measures]]) -> DataFrame:
    """(key, source, months, age, eligible, signal, contribution) for each key and source.

    sources: name -> (observed flag column, cap, measures).  Over a source's observed places each measure has a
    robust trend; the signal is their weighted sum over the absolute weights of the measures there are, within
    [-1, 1].  Without enough observed places, or with the newest too old at `origin`, there is no signal.
    """
    keys = panel.select(key).distinct()
    long, gates = None, None
    for name, (flag, _, measures) in sources.items():
        seen = panel.where(F.col(flag))
        n = seen.groupBy(key).agg(F.count("*").alias("months"), F.max(at).alias("__last"))
        gate = keys.join(n, key, "left").select(key, F.lit(name).alias("source"), F.coalesce("months", F.lit(0)).alias("months"), (origin - F.col("__last")).alias("age"))
        gates = gate if gates is None else gates.unionByName(gate)
        for measure, (weight, log, optional) in measures.items():
            v = F.log1p(F.greatest(F.col(measure), F.lit(0))) if log else F.col(measure)
            k = F.struct(F.col(key), F.lit(name).alias("source"), F.lit(weight).alias("weight"), F.lit(measure).alias("measure"), F.lit(optional).alias("optional"))
            rows = seen.select(k.alias("k"), F.col(at).alias("__at"), v.cast("double").alias("v"))
            long = rows if long is None else long.unionByName(rows)
    there = long.groupBy("k").agg(F.sum(F.abs("v")).alias("mass"))
    trends = robust_trend(long, "k", "__at", "v").join(there, "k").where(~F.col("k.optional") | (F.col("mass") > 0))
    total = F.sum(F.col("k.weight") * F.col("trend")) / F.sum(F.abs("k.weight"))
    trends = trends.groupBy(F.col(f"k.{key}").alias(key), F.col("k.source").alias("source")).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)).alias("signal"))
    eligible = (F.col("months") >= LEAST_MONTHS) & F.coalesce(F.col("age") <= OLDEST, F.lit(False))
    joined = gates.join(trends, [key, "source"], "left").withColumn("eligible", eligible)
    signal = F.when(F.col("eligible"), F.round("signal", 6))
    cap = reduce(lambda c, s: F.when(F.col("source") == s[0], s[1][1]).otherwise(c), sources.items(), F.lit(0.0))
    contribution = F.when(F.col("eligible"), F.round(F.col("signal") * cap, 6)).otherwise(0.0)
    return joined.withColumn("contribution", contribution).withColumn("signal", signal)


def factor_sentences(signals: DataFrame, key: str, labels: dict[str, str], n: int = 3) -> DataFrame:
    """(key, factors): a sentence for each source in the labels' order, but those neither observed nor
    contributing; the first n."""
    place = reduce(lambda c, x: F.when(F.col("source") == x[1], x[0]).otherwise(c), enumerate(labels), F.lit(len(labels)))
    label = reduce(lambda c, x: F.when(F.col("source") == x[0], x[1]).otherwise(c), labels.items(), F.col("source"))
    c = F.col("contribution")
    word = F.when(c > 0, "adds").when(c < 0, "takes").otherwise("neutral")
    tail = F.when(F.col("signal").isNull(), "").otherwise(F.format_string(", signal %.3f", "signal"))
    said = F.concat(label, F.lit(": "), word, F.format_string(" %.4f", c), tail)
    rows = signals.where((F.col("months") > 0) | (c != 0)).select(key, F.struct(place.alias("p"), said.alias("s")).alias("x"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("l"))  # one entry for each source
    return lists.select(key, F.transform(F.slice("l", 1, n), lambda x: x["s"]).alias("factors"))


def direction_of(values: Column, current: Column) -> Column:
    """Direction of an ordered array: by the change from current for fewer than three values, else by the slope
    and mean of the first twelve."""
    n = F.size(values)
    change = F.element_at(values, -1) - current
    first = F.slice(values, 1, 12)
    m = F.size(first)
    mean = F.aggregate(first, F.lit(0.0), lambda a, x: a + x) / m
    middle = (m - 1) / 2.0
    by_place = F.transform(first, lambda x, i: x * (i - middle))
    slope = F.aggregate(by_place, F.lit(0.0), lambda a, x: a + x) / (m * (m * m - 1) / 12.0)
    short = F.when(change >= 0.05, "up").when(change <= -0.05, "down").otherwise("flat")
    return F.when(n < 3, short).otherwise(robust_direction(slope, mean - current))


def forecast_summary(
    forecasts: DataFrame, key: str, step: str, value: str, confidence: str, current: DataFrame, months: int, direction: str | None = None, ready: str | None = None
) -> DataFrame:
    """(key, level, direction, confidence) of each key's first `months` steps.

    Up to a year: the last step as it is; its direction is the column `direction`, or told by its level.  Beyond: the
    curve is smoothed, its level the mean of the last six steps, its direction told against the key's current value
    (current: key, current).  A curve whose steps are all `ready` is not smoothed, and has its last step's direction.
    A forecast is bounded by its horizon, so its steps are one array.
    """
    told = F.col(direction) if direction else direction_by_level(F.col(value).cast("double"))
    done = F.coalesce(F.col(ready), F.lit(False)) if ready else F.lit(False)
    entry = F.struct(F.col(step), F.col(value).cast("double").alias("v"), F.col(confidence).alias("c"), told.alias("d"))
    lists = forecasts.where(F.col(step) <= months).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("l"), F.bool_and(done).alias("__ready"))
    last = F.element_at("l", -1)
    if months <= 12:
        return lists.select(key, last["v"].alias("level"), last["d"].alias("direction"), last["c"].alias("confidence"))
    lists = lists.join(current.select(key, F.col("current").cast("double").alias("__now")), key, "left").withColumn("v", F.transform("l", lambda x: x["v"]))
    smooth = lists.withColumn("s", smoothed("v")).withColumn("s", F.when(F.col("__ready"), F.col("v")).otherwise(F.col("s")))
    tail = F.slice("s", F.greatest(F.size("s") - 5, F.lit(1)), F.lit(6))
    level = F.round(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail), 6)
    way = F.when(F.col("__ready"), last["d"]).otherwise(direction_of(F.col("s"), F.coalesce("__now", F.get("s", F.lit(0)))))
    return smooth.select(key, level.alias("level"), way.alias("direction"), last["c"].alias("confidence"))


def batch_signals(roles: DataFrame, key: str, summaries: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, level, direction, confidence, source) for each role: its forecast summary, else its latest baseline
    score; roles with neither are left out.  Both tables: key, level, direction, confidence."""
    columns = ["level", "direction", "confidence"]
    a = summaries.select(key, F.struct(*columns, F.lit("forecast").alias("source")).alias("a"))
    b = baseline.select(key, F.struct(*columns, F.lit("baseline").alias("source")).alias("b"))
    joined = roles.select(key).distinct().join(a, key, "left").join(b, key, "left")
    return joined.select(key, F.coalesce("a", "b").alias("x")).where("x IS NOT NULL").select(key, "x.*")


def metric_evidence(
    panel: DataFrame, key: str, at: str, month: str, observed: str, metrics: list[str], target: str, predictions: DataFrame, history: int | None = None
) -> DataFrame:
    """One row for each key of a panel: months and values of its history, the observed range, the recent year of
    the target, the signs of each metric's change in it, the turning points, and the predicted level
    (predictions: key, predicted) or else the latest.  A panel's keys have a bounded number of months."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc())
    placed = panel.withColumn("__r", F.row_number().over(w))
    used = placed if history is None else placed.where(F.col("__r") <= history)
    entry = F.struct(F.col(at), F.col(month).cast("string").alias("month"), *[F.round(F.col(m).cast("double"), 6).alias(m) for m in metrics])
    lists = used.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    out = lists.select(key, F.col("l")["month"].alias("months"), *[F.col("l")[m].alias(f"{m}_history") for m in metrics])
    seen = panel.where(F.col(observed)).groupBy(key).agg(F.min(month).cast("string").alias("observed_from"), F.max(month).cast("string").alias("observed_to"))
    recent = recent_summary(panel.withColumn("__v", F.col(target).cast("double")), key, at, "__v")
    recent = recent.select(key, F.struct(*[F.round(c, 6).alias(c) for c in ("first", "last", "change", "slope")]).alias("recent"))
    long = placed.where("__r <= 12").select(key, at, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key, at], metrics, "metric", "value")
    ends = long.groupBy(key, "metric").agg((F.max_by("value", at) - F.min_by("value", at)).alias("change"))
    factors = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("metric", F.signum("change").cast("int").alias("sign")))).alias("factors"))
    turns = turning_points(used.withColumn("__v", F.col(target).cast("double")), key, at, "__v")
    turns = turns.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(at).alias("at")))), lambda x: x["at"]).alias("turning_points"))
    now = latest(panel.select(key, at, F.col(target).cast("double").alias("__now")), key, at).drop(at)
    for part in (seen, recent, factors, turns, now, predictions.select(key, "predicted")):
        out = out.join(part, key, "left")
    level = F.round(F.coalesce("predicted", "__now"), 6)
    return out.withColumn("level", level).withColumn("direction", direction_by_level(level)).drop("predicted", "__now")


def comparison(df: DataFrame, fit: Column, index: Column, confidence: Column) -> DataFrame:
    """Rows by .58 of the fit, .28 of the index and .14 of the confidence."""
    return df.withColumn("score", F.round(0.58 * fit + 0.28 * index + 0.14 * confidence, 6)).orderBy(F.col("score").desc())
