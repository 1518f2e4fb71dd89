"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to `bits` bits each; a point's place on the Hilbert curve orders the rows; the ordered rows are cut into shards of
equal count ("rows") or equal bytes ("bytes").  Neighbouring points share shards, so that the minimum and
maximum of every dimension in a shard's files prune reads by any of them.

All is column expressions: the curve index is Skilling's transpose written as bit operations.  Rows of one
curve cell (a hot source, thousands of equal texts) are told apart by id, so that no cell must fit a task.
Null text has no bytes; null dimensions, a null doc_id too, fall in the lowest cell.  Repeated rows take slots
of their own.  Columns other than doc_id, text, lang and source are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.common import written
from harborline.llm.merkle import ranked


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of integer coordinates below 2**bits (len(dims) * bits <= 62)."""
    n = len(dims)

    def turned(x: Column, q: Column, i: int) -> Column:
        """At level q, for each axis from i on: invert or exchange the lower bits of the first axis."""
        if i == n:
            return x
        low = q - 1
        hit = x[i].bitwiseAND(q) != 0
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
        parts = [x[j] for j in range(n)]
        parts[0] = F.when(hit, x[0].bitwiseXOR(low)).otherwise(x[0] if i == 0 else x[0].bitwiseXOR(swap))
        if i:
            parts[i] = F.when(hit, x[i]).otherwise(x[i].bitwiseXOR(swap))
        return bound(F.array(*parts), lambda y: turned(y, q, i + 1))

    def gray(x: Column) -> Column:
        return F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), [x[j] for j in range(i + 1)]) for i in range(n)])

    def flipped(x: Column) -> Column:
        mask = F.aggregate(
            levels, F.lit(0).cast("long"), lambda t, q: F.when(x[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
        )
        return bound(mask, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def woven(x: Column) -> Column:
        """The bits of all axes, from the highest level down."""
        one = F.lit(1).cast("long")
        pieces = [
            F.shiftleft(F.shiftright(x[i], b).bitwiseAND(one), b * n + n - 1 - i) for b in range(bits) for i in range(n)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), pieces)

    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.expr("array()").cast("array<long>")
    start = F.array(*[d.cast("long") for d in dims])
    return bound(bound(bound(F.aggregate(levels, start, lambda x, q: turned(x, q, 0)), gray), flipped), woven)


def scaled(value: Column, low, high, bits: int) -> Column:
    """value's place between low and high as an integer below 2**bits; null: 0."""
    if low is None or high is None or not high > low:
        return F.lit(0).cast("long")
    top = (1 << bits) - 1
    share = (value.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(share * top))), F.lit(0)).cast("long")


def with_rank(rows: DataFrame, column: str, name: str, bits: int, few: int = 65_536) -> DataFrame:
    """Add the cell of a label by its rank among all labels, so that a shard's least and greatest label follow the
    curve; null: 0.  The labels are sorted by range, however many there are; up to `few` of them are broadcast."""
    labels = rows.select(F.col(column).alias("__label")).where(F.col(column).isNotNull()).distinct()
    placed = written(ranked(labels.withColumn("__all", F.lit("")), "__all", ["__label"]), "labels")
    top = (1 << bits) - 1
    place = F.floor(F.col("pos") * (F.lit(float(top)) / F.greatest(F.lit(1), F.col("size") - 1))).cast("long")
    cells = placed.select("__label", place.alias(name))
    cells = F.broadcast(cells) if cells.count() <= few else cells
    joined = rows.join(cells, F.col(column) == F.col("__label"), "left")
    return joined.drop("__label").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def cut_along_curve(rows: DataFrame, shards: int, law: str = "rows", order: tuple[str, ...] = ()) -> DataFrame:
    """Add shard and slot to rows that have `curve` and `size`, by curve index and then the columns of order.

    "rows": shard counts at most one apart.  "bytes": each shard starts where the running sum of sizes
    passes its share of the total.  The rows are range-partitioned; what crosses partitions is one count and
    one sum for each of them.
    """
    keys = ["curve", *order]
    lane = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("__lane", F.shiftright(lane, 33)).withColumn("__at", lane.bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = written(dealt, "curve")
    lanes = dealt.groupBy("__lane").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    if law == "rows":
        ahead = Window.orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
        lanes = lanes.select(
            "__lane",
            F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"),
            F.sum("n").over(Window.partitionBy()).alias("__all"),
        )
        placed = dealt.join(lanes, "__lane").withColumn("__pos", F.col("__before") + F.col("__at"))
        shard = F.expr(f"__pos * {shards} div __all")
        first = F.expr(f"(shard * __all + {shards - 1}) div {shards}")
        placed = placed.withColumn("shard", shard).withColumn("slot", F.col("__pos") - first)
    else:
        ahead = Window.orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
        within = Window.partitionBy("__lane").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        lanes = lanes.select(
            "__lane",
            F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"),
            F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("__bytes"),
            F.sum("b").over(Window.partitionBy()).alias("__all"),
        )
        placed = dealt.withColumn("__run", F.coalesce(F.sum("size").over(within), F.lit(0))).join(lanes, "__lane")
        placed = placed.withColumn("__pos", F.col("__before") + F.col("__at"))
        middle = F.col("__bytes") + F.col("__run") + F.expr("size div 2")
        placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.greatest("__all", F.lit(1)))))
        starts = placed.groupBy("shard").agg(F.min("__pos").alias("__start"))
        placed = placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("__pos") - F.col("__start"))
    drop = [c for c in placed.columns if c.startswith("__")]
    return placed.withColumn("shard", F.col("shard").cast("int")).withColumn("slot", F.col("slot").cast("long")).drop(*drop)


def document_shards(docs: DataFrame, shards: int = 40, law: str = "rows", bits: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), curve for each document.

    Dimensions: doc_id and the logarithm of size, scaled; lang and source by rank.  size is the UTF-8 length
    plus 16.
    """
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    found = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.log2(F.min(size)).alias("least"), F.log2(F.max(size)).alias("most")).first()
    dims = [
        scaled(F.log2(F.col("size")), found.least, found.most, bits),
        F.col("__lang"),
        F.col("__source"),
        scaled(F.col("doc_id"), found.a, found.b, bits),
    ]
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    rows = with_rank(with_rank(rows, "lang", "__lang", bits), "source", "__source", bits)
    rows = rows.withColumn("curve", hilbert_index(dims, bits)).drop("lang", "source", "__lang", "__source")
    cut = cut_along_curve(written(rows, "points"), shards, law, ("doc_id", "text_crc32"))
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """docs written in a folder for each shard, in slot order, so that the least and greatest value of every
    dimension in a file's footer let readers skip it.  placed: document_shards(docs), of documents with ids of
    their own."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
