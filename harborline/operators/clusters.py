"""k-means within strata, all strata in one plan, and sparse text vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.relational import capped_sample, small
from harborline.sources.scratch import cut

#: Centres that are broadcast at a time.
MOST_CENTRES = 20_000


def strata_sizes(items: DataFrame, stratum: str, dense: list[str]) -> DataFrame:
    """(stratum, n, k): rows and clusters of each: one below 80 rows; else sqrt(n / 18) within 8 and 32 for dense
    strata, sqrt(n / 60) within 3 and 18 for others."""
    n = F.col("n")
    near = lambda share, low, high: F.least(F.lit(high), F.greatest(F.lit(low), F.rint(F.sqrt(n / share)))).cast("int")
    k = F.when(n < 80, 1).when(F.col(stratum).cast("string").isin(*dense, ""), near(18, 8, 32)).otherwise(near(60, 3, 18))
    return items.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("k", k)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each row's nearest centre; ties to the first."""
    away = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    best = away.argmin(1)
    return best, np.maximum(away[np.arange(len(x)), best], 0.0)


def first_centres(x: np.ndarray, k: int, seed: int, tries: int = 10, rounds: int = 15) -> np.ndarray:
    """Centres of a bounded sample: the best of some starts, each drawn far from those before and then settled."""
    best, least = x[:1], np.inf
    for t in range(tries if k > 1 else 1):
        rng = np.random.default_rng(seed + t)
        centres = x[rng.integers(len(x))][None, :] if k > 1 else x.mean(0, keepdims=True)
        while len(centres) < min(k, len(x)):
            far = nearest(x, centres)[1]
            far = np.ones(len(x)) if far.sum() <= 0 else far
            centres = np.concatenate([centres, x[rng.choice(len(x), p=far / far.sum())][None, :]])
        for _ in range(rounds if k > 1 else 0):
            which = nearest(x, centres)[0]
            centres = np.stack([x[which == c].mean(0) if (which == c).any() else centres[c] for c in range(len(centres))])
        cost = nearest(x, centres)[1].sum()
        if cost < least:
            best, least = centres, cost
    return best


def stratified_clusters(items: DataFrame, item: str, stratum: str, vector: str, dense: list[str], rounds: int = 10, sample: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(item, stratum, cluster, distance) and (stratum, cluster, n, centre) of k-means within each stratum.

    Centres start from a repeatable sample of at most `sample` rows of each stratum and are then settled on all rows,
    all strata in one pass a round: a task adds up its rows by (stratum, cluster), and these sums are added in a shuffle.
    The centres are broadcast, so many strata at a time as have MOST_CENTRES.  Vectors are of one length; null ones and
    null strata take no part.
    """
    rows = items.where(F.col(vector).isNotNull() & F.col(stratum).isNotNull()).select(item, stratum, F.col(vector).cast("array<double>").alias("v"))
    rows = cut(rows, "vectors")
    kind = dict(rows.dtypes)
    sizes = cut(strata_sizes(rows, stratum, dense), "strata")
    drawn = capped_sample(rows, item, sample, [stratum]).join(small(sizes), stratum)

    def start(group: pd.DataFrame) -> pd.DataFrame:
        x, name = np.stack(group.sort_values(item)["v"].to_list()), group[stratum].iloc[0]
        centres = first_centres(x, int(group["k"].iloc[0]), zlib.crc32(str(name).encode()))
        return pd.DataFrame({stratum: [name] * len(centres), "cluster": np.arange(len(centres), dtype=np.int32), "c": list(centres)})

    centres = cut(drawn.groupBy(stratum).applyInPandas(start, f"{stratum} {kind[stratum]}, cluster int, c array<double>"), "centres")
    total = centres.count()
    blocks = max(1, -(-total // MOST_CENTRES))
    block = F.pmod(F.xxhash64(stratum), F.lit(blocks))
    found, ends = [], []
    for b in range(blocks):
        mine, held = rows.where(block == b), centres.where(block == b)
        now = {}
        for r in held.orderBy(stratum, "cluster").collect():  # about MOST_CENTRES
            now.setdefault(r[stratum], []).append(r.c)
        now, counts = {s: np.array(c) for s, c in now.items()}, {}
        for _ in range(rounds):
            now, counts = _settled(mine, stratum, now)
        found.append(_assigned(mine, item, stratum, kind, now))
        ends += [(s, c, int(counts.get((s, c), 0)), x.tolist()) for s, cs in now.items() for c, x in enumerate(cs)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, items.sparkSession.createDataFrame(ends, f"{stratum} {kind[stratum]}, cluster int, n long, centre array<double>")


def _settled(rows: DataFrame, stratum: str, now: dict) -> tuple[dict, dict]:
    """Each centre's rows averaged; one without rows stays.  Also the rows of each."""
    shared = rows.sparkSession.sparkContext.broadcast(now)
    width = next((c.shape[1] for c in now.values()), 0)
    kind = dict(rows.dtypes)[stratum]

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for name, part in frame.groupby(stratum):
                x = np.stack(part["v"].to_list())
                which = nearest(x, shared.value[name])[0]
                for c in np.unique(which).tolist():
                    mine = x[which == c]
                    sums[name, c] = sums.get((name, c), 0.0) + np.append(mine.sum(0), len(mine))
        if sums:
            flat = np.stack(list(sums.values()))
            columns = {stratum: [s for s, _ in sums], "cluster": [c for _, c in sums]}
            yield pd.DataFrame(columns | {f"s{i}": flat[:, i] for i in range(flat.shape[1])})

    names = [f"s{i}" for i in range(width + 1)]
    summed = rows.mapInPandas(added, f"{stratum} {kind}, cluster int, " + ", ".join(f"{n} double" for n in names))
    new, counts = {s: c.copy() for s, c in now.items()}, {}
    for r in summed.groupBy(stratum, "cluster").agg(*[F.sum(n).alias(n) for n in names]).collect():  # a row for each centre
        x = np.array(r[2:])
        new[r[0]][r[1]], counts[r[0], r[1]] = (x[:-1] / x[-1]).round(9), x[-1]
    return new, counts


def _assigned(rows: DataFrame, item: str, stratum: str, kind: dict, now: dict) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(now)

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, part in frame.groupby(stratum):
                which, away = nearest(np.stack(part["v"].to_list()), shared.value[name])
                yield pd.DataFrame({item: part[item].to_numpy(), stratum: name, "cluster": which.astype(np.int32), "distance": away})

    return rows.mapInPandas(told, f"{item} {kind[item]}, {stratum} {kind[stratum]}, cluster int, distance double")


def hashed_cell(word: Column, dimension: int) -> Column:
    """A word's cell: the first fifteen hex digits of its MD5, modulo the dimension."""
    return (F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long") % dimension).cast("int")


def text_vectors(docs: DataFrame, key: str, words: str, dimension: int = 1 << 18) -> DataFrame:
    """(key, cells, weights): sparse TF-IDF vectors of unit length, cells ascending; texts without words, and those whose words
    all texts hold, have empty ones.

    A word's weight is its count times ln((texts + 1) / (texts with its cell + 1)).  Cells are counted with partial sums, and a
    text's own cells are brought together by its key.
    """
    texts = docs.count()
    each = docs.select(key, F.explode(words).alias("w")).where(F.col("w").isNotNull())
    counts = each.groupBy(key, hashed_cell(F.col("w"), dimension).alias("cell")).agg(F.count("*").alias("f"))
    held = counts.groupBy("cell").agg(F.count("*").alias("df"))
    weight = F.col("f") * F.log((texts + 1.0) / (F.col("df") + 1.0))
    parts = counts.join(small(held), "cell").select(key, "cell", weight.alias("x")).where("x > 0")
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cell", "x"))).alias("l"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    named = lists.select(key, F.col("l.cell").alias("cells"), F.transform("l", lambda e: e["x"] / F.col("n")).alias("weights"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return docs.select(key).join(named, key, "left").select(key, F.coalesce("cells", empty("int")).alias("cells"), F.coalesce("weights", empty("double")).alias("weights"))
