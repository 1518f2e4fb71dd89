"""Panels, series and forecast bookkeeping.  A series is (key, place, value); places are integers per key."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from harborline.functions.normalise import sigmoid, with_zscores
from harborline.operators.relational import month_grid, pairwise_slopes

#: Step decay and score constants.
FULL_STEPS, LAST_STEP = 3, 6
MILESTONES = (3, 6, 12, 24, 36)


def dense_panel(facts: DataFrame, names: DataFrame, key: str, lookback: int) -> DataFrame:
    """Every name with each of the last `lookback` months up to the facts' newest; time_idx from 0."""
    newest = facts.agg(F.max("month").alias("__last"))
    ranged = names.select(key).crossJoin(F.broadcast(newest))  # one row
    grid = month_grid(ranged, F.add_months("__last", 1 - lookback), F.col("__last"))
    place = (F.months_between("month", F.add_months("__last", 1 - lookback))).cast("int")
    return grid.withColumn("time_idx", place).drop("__last").join(facts, [key, "month"], "left")


def observed(*measures: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.abs(m) > 0, F.lit(False)) for m in measures])


def carried(panel: DataFrame, key: str, count: str, value: str) -> DataFrame:
    """Months after the key's last month with count > 0 take the last value; gaps before it become 0."""
    w = Window.partitionBy(key)
    running = w.orderBy("time_idx").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.max(F.when(F.col(count) > 0, F.col("time_idx"))).over(w)
    marked = panel.withColumn("cut", cut).withColumn("observed", F.coalesce(F.col("time_idx") <= F.col("cut"), F.lit(False)))
    inside = F.when(F.col("observed"), F.coalesce(F.col(value), F.lit(0.0)))
    marked = marked.withColumn("__in", inside)
    return marked.withColumn(value, F.coalesce(F.last("__in", ignorenulls=True).over(running), F.lit(0.0))).drop("__in")


def supervised_windows(panel: DataFrame, key: str, value: str, context: int, horizon: int) -> DataFrame:
    """(key, start, inputs, targets) where all targets are observed; windows never cross keys."""
    w = Window.partitionBy(key).orderBy("time_idx").rowsBetween(0, context + horizon - 1)
    rows = panel.select(
        key, F.col("time_idx").alias("start"), F.collect_list(F.struct(F.col(value).alias("v"), F.col("observed").alias("o"))).over(w).alias("w")
    )
    targets = F.slice("w", context + 1, horizon)
    full = rows.where((F.size("w") == context + horizon) & F.forall(targets, lambda x: x["o"]))
    return full.select(
        key, "start", F.transform(F.slice("w", 1, context), lambda x: x["v"]).alias("inputs"), F.transform(targets, lambda x: x["v"]).alias("targets")
    )


def robust_trend(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Median of pairwise slopes times the span, against the series' scale, through tanh into [-1, 1]."""
    scale = series.groupBy(key).agg(
        F.count(value).alias("n"),
        F.greatest(F.max(value) - F.min(value), F.coalesce(F.stddev_pop(value), F.lit(0.0)), F.lit(0.05)).alias("scale"),
    )
    slopes = pairwise_slopes(series, key, at, value).groupBy(key).agg(F.median("slope").alias("slope"))
    trend = F.tanh(F.col("slope") * (F.col("n") - 1) / F.col("scale"))
    return scale.join(slopes, key, "left").select(key, F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), trend)), F.lit(0.0)).alias("trend"))


def decay(step: Column) -> Column:
    return F.when(step <= FULL_STEPS, 1.0).when(step <= LAST_STEP, (LAST_STEP + 1 - step) / 4.0).otherwise(0.0)


def calibrated(signals: DataFrame, key: str, source: str, contribution: str, eligible: str, caps: dict[str, float], horizon: int, cap: float) -> DataFrame:
    """(key, source, step, contribution, adjustment, quality) for steps 1..horizon.

    A key's adjustment is the sum of its sources' contributions within +-cap, times the step's decay; where the cap cuts it,
    each source's part is cut in proportion.  quality: the caps of eligible sources over all caps.
    """
    weight = reduce(lambda c, s: F.when(F.col(source) == s[0], s[1]).otherwise(c), caps.items(), F.lit(0.0))
    totals = signals.groupBy(key).agg(F.sum(contribution).alias("__raw"), F.sum(F.when(F.col(eligible), weight).otherwise(0.0)).alias("__caps"))
    raw = F.col("__raw")
    within = F.greatest(F.lit(-cap), F.least(F.lit(cap), raw))
    steps = signals.select(key, source, F.col(contribution).alias("__c")).join(totals, key).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    scale, d = F.when(F.abs(raw) > cap, within / raw).otherwise(1.0), decay(F.col("step"))
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__caps") / sum(caps.values())))
    return steps.select(key, source, "step", F.round(F.col("__c") * scale * d, 6).alias("contribution"), F.round(within * d, 6).alias("adjustment"), quality.alias("quality"))


def standardiser(windows: DataFrame, features: list[str], targets: str, base: str) -> DataFrame:
    """One row: mean and deviation of each feature over all places of all windows, and of the targets' distances from the last
    place of `base` (a feature); deviations under 1e-6 are 1."""
    one = lambda c, name: [F.avg(c).alias(f"{name}_mean"), F.when(F.stddev_pop(c) < 1e-6, 1.0).otherwise(F.stddev_pop(c)).alias(f"{name}_sd")]
    places = windows.select(F.explode(F.arrays_zip(*features)).alias("x"))
    inputs = places.agg(*[a for f in features for a in one(F.col("x")[f], f)])
    last = F.element_at(F.col(base), -1)
    deltas = windows.select(F.explode(F.transform(targets, lambda y: y - last)).alias("d")).agg(*one(F.col("d"), "target"))
    return inputs.crossJoin(deltas)  # one row each


def standardised(windows: DataFrame, stats: DataFrame, features: list[str], targets: str, base: str) -> DataFrame:
    """windows with features and targets in deviations from their means; stats: standardiser()."""
    both = windows.withColumn("__last", F.element_at(base, -1)).crossJoin(F.broadcast(stats))  # one row
    both = both.withColumn(targets, F.transform(targets, lambda y: (y - F.col("__last") - F.col("target_mean")) / F.col("target_sd")))
    for f in features:
        both = both.withColumn(f, F.transform(f, lambda x: (x - F.col(f"{f}_mean")) / F.col(f"{f}_sd")))
    return both.select(*windows.columns)


def restored(values: Column, base: Column) -> Column:
    """Standardised targets as values again: base is the last place of the context, and target_mean and target_sd are columns."""
    return F.transform(values, lambda y: y * F.col("target_sd") + F.col("target_mean") + base)


def signal_strength(panel: DataFrame, key: str, value: str) -> DataFrame:
    seen = panel.where("observed")
    whole = panel.groupBy(key).agg(F.avg(F.col("observed").cast("double")).alias("share"))
    ends = seen.groupBy(key).agg(
        F.min_by(value, "time_idx").alias("a"), F.max_by(value, "time_idx").alias("b"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n")
    )
    rise = F.tanh((F.col("b") - F.col("a")) / F.greatest(F.abs("a"), "sd", F.lit(1e-6)))
    second = F.when(F.col("n").isNull(), 0.0).when(F.col("n") == 1, 0.5).otherwise((rise + 1) / 2)
    return whole.join(ends, key, "left").select(key, (0.65 * F.col("share") + 0.35 * second).alias("strength"))


def step_confidence(step: Column, mae: Column, strength: Column, quality: Column) -> Column:
    base = 0.70 * F.exp(-0.035 * F.greatest(step - 1, F.lit(0))) * F.greatest(F.lit(0.15), 1 - 2 * F.least(mae, F.lit(0.5)))
    c = 0.15 + base + 0.15 * strength + 0.05 * decay(step) * quality
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), c)), 4)


def direction_by_level(index: Column, high: float = 0.58, low: float = 0.42) -> Column:
    return F.when(index >= high, "up").when(index <= low, "down").otherwise("flat")


def direction_by_change(change: Column, band: float = 0.03) -> Column:
    return F.when(change > band, "up").when(change < -band, "down").otherwise("flat")


def forecast_metrics(pairs: DataFrame, actual: str, predicted: str, step: str, horizons: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """One row: mean absolute, root mean square and symmetric relative error; and at each horizon the mean absolute error and the
    share of equal directions (null where no pair has that step)."""
    e, at = F.col(predicted) - F.col(actual), F.col(step)
    same = (direction_by_level(F.col(actual)) == direction_by_level(F.col(predicted))).cast("double")
    by_step = [x for h in horizons for x in (F.avg(F.when(at == h, F.abs(e))).alias(f"horizon_{h}_mae"), F.avg(F.when(at == h, same)).alias(f"horizon_{h}_direction_accuracy"))]
    return pairs.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(2 * F.abs(e) / (F.abs(actual) + F.abs(predicted) + 1e-6)).alias("smape"), *by_step,
    )


def weighted_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Z-scores over the table times weights, each rounded before the sum, through a sigmoid; contributions kept."""
    z = with_zscores(df, list(weights))
    z = z.withColumn("contributions", F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.round(F.col(f"{c}_z") * w, 6))]))
    total = reduce(lambda a, b: a + b, [F.col("contributions")[c] for c in weights])
    return z.withColumn("score", F.round(sigmoid(total), 6)).drop(*[f"{c}_z" for c in weights])


def top_factors(contributions: Column, least: float = 0.03, n: int = 3) -> Column:
    """Names of the n largest contributions by absolute value above least."""
    entries = F.filter(F.map_entries(contributions), lambda e: F.abs(e["value"]) > least)
    order = F.array_sort(F.transform(entries, lambda e: F.struct((-F.abs(e["value"])).alias("a"), e["key"].alias("k"))))
    return F.transform(F.slice(order, 1, n), lambda e: e["k"])


def score_confidence(available: Column, flags: list[Column]) -> Column:
    weights = (0.15, 0.13, 0.10, 0.10)
    c = 0.22 + 0.30 * F.least(available / 3, F.lit(1.0))
    return F.least(F.lit(0.98), reduce(lambda a, fw: a + F.when(fw[0], fw[1]).otherwise(0.0), zip(flags, weights), c))


def repaired(curves: np.ndarray) -> np.ndarray:
    """Curves (rows, steps) of six steps and more, smoothed; a dip is bridged.

    A dip runs from the first to the last step under .6 of the median of the first twelve (their mean, if the median
    is under .01).  It becomes the line from the mean of up to three steps before it (the first step, if there is
    none) to that of three steps after it (.9 of the former, if there is none); the curve is then averaged, .6 new
    and .4 old, and no step leaves 15 % of the step before, as that was adjusted, where that is over .02.  Without a
    dip it is only averaged, .7 new and .3 old.  One scan over the steps serves all rows.
    """
    n, head = curves.shape[1], curves[:, :12]
    base = np.median(head, axis=1)
    base = np.where(base < 0.01, head.mean(1), base)
    low = curves < 0.6 * base[:, None]
    dips = low.any(1)
    at = np.arange(n)[None, :]
    start = np.where(dips, low.argmax(1), 0)[:, None]
    stop = np.where(dips, n - low[:, ::-1].argmax(1), 0)[:, None]

    def mean_of(inside: np.ndarray, without: np.ndarray) -> np.ndarray:
        count = inside.sum(1, keepdims=True)
        return np.where(count > 0, np.where(inside, curves, 0.0).sum(1, keepdims=True) / np.maximum(count, 1), without)

    before = mean_of((at >= start - 3) & (at < start), curves[:, :1])
    after = mean_of((at >= stop) & (at < stop + 3), before * 0.9)
    share = (at - start) / np.maximum(stop - start, 1)
    out = np.where((at >= start) & (at < stop), before * (1 - share) + after * share, curves)
    new, old = np.where(dips, 0.6, 0.7), np.where(dips, 0.4, 0.3)
    mean = out[:, 0].copy()
    for i in range(1, n):
        mean = new * out[:, i] + old * mean
        last = out[:, i - 1]
        held = np.clip(mean, last * 0.85, last * 1.15)
        out[:, i] = np.where(dips & (last > 0.02), held, mean)
    return np.round(np.clip(out, 0.0, 1.0), 6)


@F.pandas_udf(ArrayType(DoubleType()))
def smoothed(values: pd.Series) -> pd.Series:
    """repaired() of arrays of six values and more; shorter ones, and those with a null, stay as they are."""
    out, sizes = values.copy(), values.map(lambda v: -1 if v is None else len(v))
    for n in sorted(set(sizes[sizes >= 6])):
        places = np.flatnonzero(sizes == n)
        curves = np.array([np.asarray(values.iloc[p], np.float64) for p in places])
        whole = ~np.isnan(curves).any(1)
        for p, curve in zip(places[whole], repaired(curves[whole])):
            out.iloc[p] = curve
    return out


def robust_direction(slope: Column, gap: Column) -> Column:
    return (
        F.when(slope > 0.002, "up").when(slope < -0.005, "down").when((slope < -0.003) & (gap < -0.03), "down").otherwise("flat")
    )


def turning_points(series: DataFrame, key: str, at: str, value: str, n: int = 5, z: float = 1.5) -> DataFrame:
    """Steps whose first difference lies z deviations off the key's mean difference; the n largest."""
    w = Window.partitionBy(key)
    d = F.col(value) - F.lag(value).over(w.orderBy(at))
    steps = series.withColumn("diff", d).where("diff is not null")
    steps = steps.withColumn("z", (F.col("diff") - F.avg("diff").over(w)) / F.nullif(F.stddev_pop("diff").over(w), F.lit(0.0)))
    hits = steps.where(F.abs("z") >= z)
    rank = F.row_number().over(w.orderBy(F.abs("diff").desc(), F.col(at)))
    ratio = F.col("diff") / F.nullif(F.col(value) - F.col("diff"), F.lit(0.0))
    return hits.withColumn("rank", rank).where(F.col("rank") <= n).select(key, at, "diff", "z", ratio.alias("ratio"), "rank")


def recent_summary(series: DataFrame, key: str, at: str, value: str, n: int = 12) -> DataFrame:
    """First, last, change and slope of each key's last n places."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc())
    recent = series.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return recent.groupBy(key).agg(
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.regr_slope(value, at).alias("slope"), F.count("*").alias("n")
    ).withColumn("change", F.col("last") - F.col("first"))


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), at).alias("r")).select(key, "r.*")


def drift_forecast(series: DataFrame, key: str, at: str, value: str, horizon: int) -> DataFrame:
    """Last value plus the mean step, for steps 1..horizon, clipped at 0."""
    ends = series.groupBy(key).agg(F.min_by(value, at).alias("a"), F.max_by(value, at).alias("b"), (F.max(at) - F.min(at)).alias("span"))
    slope = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.col("span"), F.lit(0)), F.lit(0.0))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(key, "step", F.greatest(F.lit(0.0), F.col("b") + slope * F.col("step")).alias("forecast"))
