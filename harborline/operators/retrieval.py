"""Evidence retrieval, vector recall, ranking and its evaluation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from harborline.operators.relational import small, top_per_key
from harborline.sources.scratch import cut

#: Fixed values of the ranking function.
K1, B = 1.5, 0.75
#: Texts whose words are Python's at a time.
FEW_TEXTS = 250


def bm25_by_group(docs: DataFrame, group: str, doc: str, words: str, queries: DataFrame, query_words: str, k: int, digits: int = 5, most_words: int = 200_000) -> DataFrame:
    """(group, doc, score, rank): the k best documents of each group for the group's own query, ties by doc.

    Frequencies and mean length are those of the group's documents; a query's repeated words count again (queries: group,
    words; several rows of a group are one query).  The weights are counted and broadcast, so many groups at a time as
    have about most_words of them, and meet the documents where they are: of a group, however large, k rows leave a task.
    Documents without a group, or whose group has no query, have no score.
    """
    stats = docs.groupBy(group).agg(F.count("*").alias("__n"), F.avg(F.size(words)).alias("__mean"))
    asked = queries.select(group, F.explode(query_words).alias("__w")).groupBy(group, "__w").agg(F.count("*").alias("__times"))
    each = docs.select(group, F.explode(F.array_distinct(words)).alias("__w"))
    held = each.join(small(asked.select(group, "__w")), [group, "__w"], "left_semi").groupBy(group, "__w").agg(F.count("*").alias("__df"))
    idf = F.log(1 + (F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
    weighed = cut(asked.join(held, [group, "__w"]).join(stats, group).select(group, "__mean", "__w", (F.col("__times") * idf).alias("__x")), "weights")
    blocks = max(1, -(-weighed.count() // most_words))
    of = lambda df, b: df if blocks == 1 else df.where(F.pmod(F.xxhash64(group), F.lit(blocks)) == b)
    schema = ", ".join(f"{c} {t}" for c, t in (*((c, dict(docs.dtypes)[c]) for c in (group, doc)), ("score", "double")))
    kind = to_arrow_schema(_parse_datatype_string(schema))
    out = None
    for b in range(blocks):
        weights: dict = {}
        for g, mean, w, x in of(weighed, b).collect():  # about most_words
            weights.setdefault(g, (mean, {}))[1][w] = x
        model = docs.sparkSession.sparkContext.broadcast(weights)

        def best(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            top: dict = {}
            for piece in (batch.slice(at, FEW_TEXTS) for batch in batches for at in range(0, len(batch), FEW_TEXTS)):
                for g, d, ws in zip(*(column.to_pylist() for column in piece.columns)):
                    if g not in model.value or ws is None:
                        continue
                    mean, weight = model.value[g]
                    long = K1 * (1 - B + B * len(ws) / mean)
                    found = Counter(w for w in ws if w in weight)
                    score = round(sum(weight[w] * f * (K1 + 1) / (f + long) for w, f in sorted(found.items())), digits)
                    if score > 0:
                        top.setdefault(g, []).append((-score, d))
                for g, rows in top.items():
                    if len(rows) > k:
                        top[g] = sorted(rows)[:k]
            rows = [(g, d, -s) for g, held in top.items() for s, d in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

        lists = of(docs.select(group, doc, words), b).mapInArrow(best, schema)
        out = lists if out is None else out.unionByName(lists)
    return top_per_key(out, [group], [F.col("score").desc(), F.col(doc)], k)


def _merged(best: tuple[np.ndarray, np.ndarray] | None, scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, docs) of each query (column), of those held and new ones; ties by doc."""
    docs = np.broadcast_to(docs[:, None], scores.shape)
    if best is not None:
        scores, docs = np.concatenate([best[0], scores]), np.concatenate([best[1], docs])
    order = np.argsort(docs, axis=0, kind="stable")
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(scores, order, 0), axis=0, kind="stable"), 0)[:k]
    return np.take_along_axis(scores, order, 0), np.take_along_axis(docs, order, 0)


def bm25_top(docs: DataFrame, doc: str, words: str, queries: DataFrame, query: str, query_words: str, k: int, digits: int = 5, most_queries: int = 1000) -> DataFrame:
    """(query, doc, score): the k best documents of each query, ties by doc, by frequencies of the whole table.  words: array
    columns; a query's repeated words count again; scores are rounded to `digits` before they are ranked.

    The queries are counted and broadcast in blocks, as inverted lists: for each word the queries that hold it, and
    its weight in them.  A batch of documents meets only the lists of its own words, and one list of k rows a query
    leaves a task.
    """
    spark = docs.sparkSession
    n, mean = docs.agg(F.count("*"), F.avg(F.size(words))).first()
    blocks = max(1, -(-queries.count() // most_queries))
    kinds = dict(queries.dtypes)[query], dict(docs.dtypes)[doc]
    schema = f"{query} {kinds[0]}, {doc} {kinds[1]}, score double"
    out = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)
        asked = [(r[0], Counter(r[1])) for r in mine.select(query, query_words).collect()]  # at most about most_queries
        vocabulary = sorted({w for _, ws in asked for w in ws})
        if not vocabulary or not n:
            continue
        terms = small(spark.createDataFrame([(w,) for w in vocabulary], "w string"))
        held = docs.select(F.explode(F.array_distinct(words)).alias("w")).join(terms, "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
        lists = {}
        for w, df in held.collect():  # a row for each word of the block
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            of = [(i, ws[w] * idf) for i, (_, ws) in enumerate(asked) if w in ws]
            lists[w] = np.array([i for i, _ in of]), np.array([x for _, x in of])
        model = spark.sparkContext.broadcast((lists, [q for q, _ in asked]))

        def best(frames: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            lists, names = model.value
            top = None
            for frame in frames:
                for start in range(0, len(frame), 512):
                    part = frame.iloc[start : start + 512]
                    scores, found = np.zeros((len(part), len(names))), {}
                    for i, ws in enumerate(part["w"]):
                        for w, f in Counter(w for w in ws if w in lists).items():
                            found.setdefault(w, ([], []))
                            found[w][0].append(i)
                            found[w][1].append(f / (f + K1 * (1 - B + B * len(ws) / mean)))
                    for w in sorted(found):
                        at, weight = lists[w]
                        scores[np.ix_(found[w][0], at)] += np.outer(found[w][1], weight * (K1 + 1))
                    top = _merged(top, np.round(scores, digits), part["d"].to_numpy(), k)
            if top is not None:
                place, which = np.nonzero(top[0] > 0)
                yield pd.DataFrame({"q": [names[j] for j in which], "d": top[1][place, which], "s": top[0][place, which]})

        found = docs.select(F.col(doc).alias("d"), F.col(words).alias("w")).mapInPandas(best, f"q {kinds[0]}, d {kinds[1]}, s double")
        found = found.select(F.col("q").alias(query), F.col("d").alias(doc), F.col("s").alias("score"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return top_per_key(out, [query], [F.col("score").desc(), F.col(doc)], k).drop("rank")


def alignment(tone: Column, falling: Column, bonus: Column) -> Column:
    base = 0.5 + 0.5 * F.tanh(tone / 5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(falling, 1 - base).otherwise(base) + bonus))


def composite(df: DataFrame, group: str, relevance: str, parts: dict[str, float], relevance_weight: float = 0.25) -> DataFrame:
    """relevance over the group's largest, plus weighted parts in [0, 1].  The largest are joined back, so that no
    group is gathered."""
    most = df.groupBy(group).agg(F.max(relevance).alias("__most"))
    total = relevance_weight * F.coalesce(F.col(relevance) / F.nullif(F.col("__most"), F.lit(0.0)), F.lit(0.0))
    for c, w in parts.items():
        total = total + w * F.col(c)
    return df.join(small(most), group).withColumn("rank_score", total).drop("__most")


def with_recency(df: DataFrame, group: str, at: str, name: str) -> DataFrame:
    """Add the place of a date between the group's first and last; 0 if they are equal."""
    ends = df.groupBy(group).agg(F.min(at).alias("__a"), F.max(at).alias("__b"))
    place = F.datediff(F.col(at), F.col("__a")) / F.greatest(F.datediff("__b", "__a"), F.lit(1))
    return df.join(small(ends), group).withColumn(name, place).drop("__a", "__b")


def first_by_url_then_title(df: DataFrame, group: str, url: str, title: str, order: list[Column]) -> DataFrame:
    """Best row of each URL, then best of each non-empty title; a row dropped for its URL hides no title."""
    r = F.row_number().over(Window.partitionBy(group, url).orderBy(*order))
    urls = df.withColumn("__r", r).where("__r = 1")
    s = F.row_number().over(Window.partitionBy(group, title).orderBy(*order))
    return urls.withColumn("__s", s).where((F.col("__s") == 1) | (F.col(title) == "")).drop("__r", "__s")


def in_range_first(df: DataFrame, group: str, at: str, low: Column, high: Column, order: list[Column], n: int) -> DataFrame:
    """n rows of each group in the range; a group with none gives its whole pool, flagged out of range."""
    inside = df.where(F.col(at).between(low, high)).withColumn("in_range", F.lit(True))
    some = inside.select(group).distinct()
    pool = inside.unionByName(df.join(some, group, "left_anti").withColumn("in_range", F.lit(False)))
    return top_per_key(pool, [group], order, n)


def normalised(v: Column) -> Column:
    """The vector by its length; the zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.array(length), lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n)))[0]


#: Scores that a task holds at a time; how far a product in blocks may be from the sum in order of the components.
CELLS, SLACK = 1 << 21, 1e-9


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): vectors by their length; null if a component is.  Rows without key meet nobody."""
    v = normalised(F.col(vector))
    return df.where(F.col(key).isNotNull()).select(key, F.when(~F.exists(v, lambda x: x.isNull()), v).alias("v"))


def _blocks(queries: DataFrame, query: str, most: int) -> Iterator[dict]:
    """About `most` queries at a time, broadcast: {length: (keys, matrix)}; null vectors under length None."""
    blocks = max(1, -(-queries.count() // most))
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)
        by_length: dict = {}
        for key, v in mine.collect():  # one bounded block
            by_length.setdefault(None if v is None else len(v), []).append((key, v))
        held = {n: (np.array([k for k, _ in q]), np.array([v for _, v in q], float).reshape(len(q), -1) if n is not None else None) for n, q in by_length.items()}
        yield queries.sparkSession.sparkContext.broadcast(held)


def _tiles(frame: pd.DataFrame, item: str, asked: dict) -> Iterator[tuple]:
    """(length of the queries, their scores with a tile of the items, the items' keys and vectors).

    Scores that are null, since a vector is or the lengths differ, are -inf, and so is a row's own; NaN is above all."""
    ids, length = np.asarray(frame[item].tolist()), np.array([-1 if v is None else len(v) for v in frame["v"]])
    for n, (names, q) in asked.items():
        step = max(1, CELLS // len(names))
        for at in range(0, len(ids), step):
            here, same = ids[at : at + step], length[at : at + step] == (-2 if n is None else n)
            scores, v = np.full((len(names), len(here)), -np.inf), None
            if same.any():
                v = np.zeros((len(here), n))
                v[same] = np.stack(frame["v"].iloc[at : at + step][same].to_list())
                scores = q @ v.T
                scores[np.isnan(scores)] = np.inf
                scores[:, ~same] = -np.inf
            yield n, scores, here, v


def _score(c: str) -> Column:
    """What a tile has as -inf is null, what it has as inf is NaN."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    return F.when(F.col(c) == high, F.lit(float("nan"))).when(F.col(c) != low, F.col(c))


def _in_order(q: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of the rows r of q and c of v, summed in the order of the components: equal vectors score equally."""
    total, left, right = np.zeros(len(r)), np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
    for a, b in zip(left, right):
        total += a[r] * b[c]
    return total


def cosine_top(items: DataFrame, item: str, vector: str, queries: DataFrame, query: str, query_vector: str, n: int, most_queries: int = 10_000) -> DataFrame:
    """The n nearest items of each query by cosine, ties by item.

    The queries are a stated set: they are counted, and broadcast in blocks of most_queries; each block reads the
    items once, dealt over all cores.  A tile of items meets the block in one product; what reaches a query's n-th
    score so far is summed again in order, so that ties are ties, and n rows a query leave a task.
    """
    spark, kinds = items.sparkSession, (dict(queries.dtypes)[query], dict(items.dtypes)[item])
    v = _vectors(items, item, vector).repartition(spark.sparkContext.defaultParallelism, item)
    out = None
    for model in _blocks(_vectors(queries, query, query_vector), query, most_queries):

        def best(frames: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for frame in frames:
                for length, scores, here, vectors in _tiles(frame, item, model.value):
                    names, q = model.value[length]
                    rows, wide = scores.shape
                    r, s, i = held.get(length, (np.zeros(0, int), np.zeros(0), here[:0]))
                    ends = np.searchsorted(r, np.arange(rows), "right")
                    full = np.bincount(r, minlength=rows) == n
                    least = np.where(full, s[ends - 1] if len(s) else -np.inf, -np.inf)
                    some = np.nonzero(np.isneginf(least))[0]
                    own = np.nonzero(np.isin(here, names))[0]
                    mine = names[:, None] == here[own][None, :]
                    scores[:, own] = np.where(mine, -np.inf, scores[:, own])
                    if len(some) and wide > n:
                        least[some] = np.partition(scores[some], wide - n, axis=1)[:, wide - n]
                    reached = scores >= (least - SLACK)[:, None]
                    reached[:, own] &= ~mine
                    a, b = np.nonzero(reached)
                    found = scores[a, b]
                    real = np.isfinite(found)
                    if real.any():
                        found[real] = _in_order(q, vectors, a[real], b[real])
                    r, s, i = np.concatenate([r, a]), np.concatenate([s, found]), np.concatenate([i, here[b]])
                    order = np.lexsort((i, -s, r))
                    r, s, i = r[order], s[order], i[order]
                    good = np.arange(len(r)) - np.searchsorted(r, np.arange(rows))[r] < n
                    held[length] = r[good], s[good], i[good]
            for length, (r, s, i) in held.items():
                yield pd.DataFrame({"q": model.value[length][0][r], "i": i, "s": s})

        found = v.mapInPandas(best, f"q {kinds[0]}, i {kinds[1]}, s double").select(F.col("q").alias(query), F.col("i").alias(item), _score("s").alias("score"))
        out = found if out is None else out.unionByName(found)
    return top_per_key(out, [query], [F.col("score").desc(), F.col(item)], n)


def best_similarity(items: DataFrame, item: str, vector: str, targets: DataFrame, target: str, target_vector: str, most_targets: int = 10_000) -> DataFrame:
    """(item, best): the highest cosine of each item with any target but itself.

    Targets are counted and broadcast in blocks; each block meets the items in tiles, dealt over all cores, and leaves one
    maximum for an item, no list of pairs.
    """
    kind = dict(items.dtypes)[item]
    v = _vectors(items, item, vector).repartition(items.sparkSession.sparkContext.defaultParallelism, item)
    out = None
    for model in _blocks(_vectors(targets, target, target_vector), target, most_targets):

        def best(frames: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for length, scores, here, _ in _tiles(frame, item, model.value):
                    names = model.value[length][0]
                    own = np.nonzero(np.isin(here, names))[0]
                    scores[:, own] = np.where(names[:, None] == here[own][None, :], -np.inf, scores[:, own])
                    yield pd.DataFrame({"i": here, "b": scores.max(axis=0)})

        each = v.mapInPandas(best, f"i {kind}, b double").select(F.col("i").alias(item), _score("b").alias("best"))
        out = each if out is None else out.unionByName(each)
    return out.groupBy(item).agg(F.max("best").alias("best"))


def swept_metrics(ranked: DataFrame, query: str, item: str, base: str, penalty: str, relevant: str, totals: DataFrame, total: str, values: list[float], k: int) -> DataFrame:
    """(gamma, hit1, hitk, mrr, ndcg): means over the queries of the ranking by base - gamma * penalty."""
    swept = ranked.withColumn("gamma", F.explode(F.array(*[F.lit(v) for v in values])))
    swept = swept.withColumn("__s", F.round(F.col(base) - F.col("gamma") * F.col(penalty), 9)).withColumn("__q", F.struct(query, "gamma"))
    placed = top_per_key(swept, ["__q"], [F.col("__s").desc(), F.col(item)], k)
    wanted = totals.withColumn("gamma", F.explode(F.array(*[F.lit(v) for v in values]))).select(F.struct(query, "gamma").alias("__q"), total)
    each = ranking_metrics(placed, "__q", relevant, wanted, total, k)
    return each.groupBy(F.col("__q.gamma").alias("gamma")).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("hit1", "hitk", "mrr", "ndcg")])


def extraction_rows(rows: DataFrame, key: str, gold: str, found: str, fields: dict[str, tuple[str, float | None]]) -> DataFrame:
    """Per row: tp, fp, fn, missing and extra items, and for each field whether it is right (null without gold).

    Items as sets, case aside.  fields: gold column -> (found column, tolerance of numbers or None).
    """
    low = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(x)))
    g, f = low(gold), low(found)
    right = {}
    for name, (mine, tolerance) in fields.items():
        same = F.col(name) == F.col(mine) if tolerance is None else F.abs(F.col(name) - F.col(mine)) <= tolerance
        right[f"{name}_right"] = F.when(F.col(name).isNotNull(), F.coalesce(same, F.lit(False)))
    return rows.select(
        key, F.size(F.array_intersect(g, f)).alias("tp"), F.size(F.array_except(f, g)).alias("fp"), F.size(F.array_except(g, f)).alias("fn"),
        F.array_sort(F.array_except(g, f)).alias("missing"), F.array_sort(F.array_except(f, g)).alias("extra"), *[c.alias(n) for n, c in right.items()],
    )


def tiered(full: Column, graph: Column, overlap: Column, lists: dict[str, Column], n: int = 5) -> Column:
    """Struct (tier, score, the lists cut at n): the full ranking; else the larger of the graph's and the
    overlap's score; else the overlap's."""
    score = F.coalesce(full, F.greatest(graph, overlap), overlap)
    tier = F.when(full.isNotNull(), 1).when(graph.isNotNull(), 2).otherwise(3)
    return F.struct(tier.alias("tier"), F.round(score, 4).alias("score"), *[F.slice(c, 1, n).alias(name) for name, c in lists.items()])


def skill_gap(have: Column, need: Column) -> tuple[Column, Column]:
    """Needed skills that are there and that are missing, in the needed order, case aside."""
    low = F.transform(have, lambda x: F.lower(x))
    return F.filter(need, lambda x: F.array_contains(low, F.lower(x))), F.filter(need, lambda x: ~F.array_contains(low, F.lower(x)))


def ranking_metrics(ranked: DataFrame, query: str, relevant: str, totals: DataFrame, total: str, k: int) -> DataFrame:
    """hit1, hitk, mrr, ndcg per query over its ranked list; totals: how many are relevant at all."""
    gain = F.when(F.col(relevant) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    g = ranked.groupBy(query).agg(
        F.max((F.col(relevant) & (F.col("rank") == 1)).cast("int")).alias("hit1"),
        F.max((F.col(relevant) & (F.col("rank") <= k)).cast("int")).alias("hitk"),
        F.coalesce(F.max(F.when(F.col(relevant), 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(gain).alias("dcg"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col(total), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    ndcg = F.when(F.col(total) > 0, F.col("dcg") / best).otherwise(0.0)
    return g.join(totals, query).select(query, "hit1", "hitk", "mrr", ndcg.alias("ndcg"))


def extraction_scores(rows: DataFrame, gold: str, found: str) -> DataFrame:
    """Micro precision, recall and F1 over two array columns, as sets."""
    g, f = F.array_distinct(gold), F.array_distinct(found)
    sums = rows.agg(
        F.sum(F.size(F.array_intersect(g, f))).alias("tp"), F.sum(F.size(F.array_except(f, g))).alias("fp"), F.sum(F.size(F.array_except(g, f))).alias("fn")
    )
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return sums.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-12)), 6).alias("f1"))
