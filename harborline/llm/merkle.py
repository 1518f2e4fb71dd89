"""A Merkle manifest with incremental witnesses.

Every row is a leaf: the SHA-256 of its length-prefixed fields.  The leaves of a source ascend by id; runs of `arity`
consecutive digests become their digest, level by level, until one subroot is left, and the subroots, by source, become
one root in the same way.

A frontier keeps the open run of each level.  Appending a leaf attaches an empty witness to it; when a run closes, every
leaf below it gets the run's other digests, and the run's digest is appended to the level above.  Sources are cut into
aligned blocks of arity ** levels leaves, each streamed through a frontier of its own; a block's root is a node of its
level, so block roots are appended to further frontiers, tier after tier.  Roots travel up first; then each block
gets its root's witness as one row ahead of its leaves and extends theirs by it.  No task holds more than one block, a
source of any size is many blocks, and a witness never leaves the block that it is made in.

Ids that repeat in a source are ordered by leaf digest, null ids come first; equal rows are leaves of their own.  A null
source is a source.  Texts may be null, empty or of any length.  No rows: no result.  Columns other than the
fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.common import in_pieces, released, written

ARITY, LEVELS = 16, 2
#: Rows of a table that is broadcast: a lane of the sorted leaves and a source in it.
MOST_BROADCAST = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 length, a colon and its value."""
    parts = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Frontier:
    """The open runs of one aligned block, level by level; a node is its digest and the witnesses below it."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.open = arity, [[]]

    def append(self, leaf: str) -> list[tuple[str, str]]:
        """Put a leaf at the end; returns its witness, which grows as later siblings complete runs."""
        witness: list[tuple[str, str]] = []
        self._put(0, leaf, [witness])
        return witness

    def _put(self, level: int, node: str, below: list) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        whole = "".join(node for node, _ in run)
        at, under = 0, []
        for node, below in run:
            step = (whole[:at], whole[at + len(node) :])
            at += len(node)
            for witness in below:
                witness.append(step)
            under += below
        self._put(level + 1, digest(whole), under)

    def close(self, height: int) -> str:
        """Complete what is open up to `height`, whose only node is the root."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def height_of(nodes: int, arity: int, levels: int) -> int:
    """Levels that a block is raised: all of them in a tree of several blocks, else until one node is left."""
    height, room = 0, 1
    while room < nodes and height < levels:
        height, room = height + 1, room * arity
    return height


def folded(leaf: str, witness: list[tuple[str, str]]) -> str:
    return reduce(lambda node, step: digest(step[0] + node + step[1]), witness, leaf)


def _by_block(df: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """rows(list of a block's rows) for each block of a tree: (tree, pos div span), in order of pos."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, found = [], None, []
        for piece in (p for batch in batches for p in in_pieces(batch)):
            for row in piece.to_pylist():
                here = (row["tree"], row["block"])
                if here != key and held:
                    found += rows(held)
                    held = []
                    if len(found) >= 4096:
                        yield batch_of(found)
                        found = []
                key = here
                held.append(row)
        if held:
            found += rows(held)
        if found:
            yield batch_of(found)
        released()

    dealt = df.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.select(*columns).mapInArrow(run, schema)


def ranked(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df with pos, a row's place in its tree, and size, the tree's rows.

    The rows are sorted by range and written; what crosses ranges is one count for each tree in each range.
    """
    lane = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    dealt = dealt.withColumn("__lane", F.shiftright(lane, 33)).withColumn("__at", lane.bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = written(dealt, "leaves")
    counts = dealt.groupBy(F.col("__lane").alias("__l"), F.col(tree).alias("__t")).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    ahead = Window.partitionBy("__t").orderBy("__l").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__l", "__t", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("n").over(Window.partitionBy("__t")).alias("size"),
    )
    starts = written(starts, "starts")
    few = starts.count() <= MOST_BROADCAST
    placed = dealt.join(F.broadcast(starts) if few else starts, (F.col("__lane") == F.col("__l")) & F.col(tree).eqNullSafe(F.col("__t")))
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__lane", "__at", "__l", "__t", "__shift")


def raised(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Tiers of nodes (tree, pos, size, node): the given one, its block roots, theirs, until each tree has one."""
    span = arity**levels

    def root(rows: list[dict]) -> list[tuple]:
        frontier = Frontier(arity)
        for row in rows:
            frontier.append(row["node"])
        size = rows[0]["size"]
        return [(rows[0]["tree"], rows[0]["block"], -(-size // span), frontier.close(height_of(size, arity, levels)))]

    tiers, most = [nodes], nodes.agg(F.max("size")).first()[0]
    while most > 1:
        below = tiers[-1].withColumn("block", F.expr(f"pos div {span}"))
        up = _by_block(below, ["tree", "block", "size", "node"], "tree string, pos long, size long, node string", root)
        tiers.append(written(up, "tier"))
        most = -(-most // span)
    return tiers


def lowered(tiers: list[DataFrame], top: DataFrame, arity: int, levels: int) -> DataFrame:
    """Witness rows (tree, pos, witness, subroot) of the lowest tier but one block level: what its blocks' roots have.

    top: (tree, witness, subroot) of each tree's root.
    """
    span = arity**levels

    def extended(rows: list[dict]) -> list[tuple]:
        head, frontier, size = rows[0], Frontier(arity), rows[1]["size"]
        mine = [(row["pos"], frontier.append(row["node"])) for row in rows[1:]]
        frontier.close(height_of(size, arity, levels))
        rest = [(s["before"], s["after"]) for s in head["witness"]]
        return [(head["tree"], pos, [{"before": a, "after": b} for a, b in witness + rest], head["subroot"]) for pos, witness in mine]

    heads = top.select("tree", F.lit(0).cast("long").alias("pos"), "witness", "subroot")
    for tier in reversed(tiers[1:-1]):
        mixed = headed(tier, heads, span)
        columns = ["tree", "block", "pos", "size", "node", "witness", "subroot"]
        heads = written(_by_block(mixed, columns, f"tree string, pos long, witness {STEPS}, subroot string", extended), "witnesses")
    return heads


def headed(nodes: DataFrame, heads: DataFrame, span: int) -> DataFrame:
    """The nodes of each block behind one row, at pos -1, that has the witness of the block's root."""
    ahead = heads.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "witness", "subroot")
    return nodes.withColumn("block", F.expr(f"pos div {span}")).unionByName(ahead, allowMissingColumns=True)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_column: str = "doc_id",
    tree_column: str = "source",
    altered: dict[str, Column] | None = None,
    arity: int = ARITY,
    levels: int = LEVELS,
    with_witness: bool = False,
) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; with_witness adds `witness`, the digests
    before and after one's own in each run on the way to the root.

    altered: new values of fields; folded_root is recomputed from the altered row's leaf and the original witness, and
    verified tells whether it is the root.  proof_sha256 is the digest of the witness, level by level.
    """
    span = arity**levels
    leaf = leaf_digest([F.col(f) for f in fields])
    now = leaf_digest([(altered or {}).get(f, F.col(f)) for f in fields]) if altered else leaf
    rows = docs.select(F.col(id_column).alias("id"), F.col(tree_column).cast("string").alias("tree"), leaf.alias("node"), now.alias("now"))
    rows = rows.withColumn("now", F.when(F.col("now") != F.col("node"), F.col("now")))  # null where nothing changed
    kind = dict(rows.dtypes)["id"]
    output = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    output += f", witness {STEPS}" if with_witness else ""
    leaves = written(ranked(rows, "tree", ["id", "node"]), "ranked")
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], output).withColumnRenamed("id", id_column)
    tiers = raised(leaves.select("tree", "pos", "size", "node"), arity, levels)

    subroots = tiers[-1].select(F.col("tree").alias("source"), "node", F.lit("").alias("tree"))
    sources = written(ranked(subroots, "tree", ["source"]), "sources")
    over = raised(sources.select("tree", "pos", "size", "node"), arity, levels)
    root = over[-1].first().node
    nothing = F.array().cast(STEPS)
    top = over[-1].select("tree", nothing.alias("witness"), F.lit(None).cast("string").alias("subroot"))

    def of_sources(rows: list[dict]) -> list[tuple]:
        head, frontier, size = rows[0], Frontier(arity), rows[1]["size"]
        mine = [(row["source"], row["node"], frontier.append(row["node"])) for row in rows[1:]]
        frontier.close(height_of(size, arity, levels))
        rest = [(s["before"], s["after"]) for s in head["witness"]]
        return [(source, [{"before": a, "after": b} for a, b in witness + rest], node) for source, node, witness in mine]

    mixed = headed(sources, lowered(over, top, arity, levels), span)
    columns = ["tree", "block", "pos", "size", "source", "node", "witness"]
    subtops = written(_by_block(mixed, columns, f"tree string, witness {STEPS}, subroot string", of_sources), "subroots")

    def of_leaves(rows: list[dict]) -> list[tuple]:
        head, frontier, size = rows[0], Frontier(arity), rows[1]["size"]
        mine = [(row, frontier.append(row["node"])) for row in rows[1:]]
        frontier.close(height_of(size, arity, levels))
        rest, found = [(s["before"], s["after"]) for s in head["witness"]], []
        for row, witness in mine:
            witness += rest
            proof = digest("".join(before + after for before, after in witness))
            back = folded(row["now"] or row["node"], witness)
            found.append((row["id"], row["node"], head["subroot"], root, proof, back, back == root))
            if with_witness:
                found[-1] += ([{"before": a, "after": b} for a, b in witness],)
        return found

    mixed = headed(leaves, lowered(tiers, subtops, arity, levels), span)
    columns = ["tree", "block", "pos", "size", "id", "node", "now", "witness", "subroot"]
    return _by_block(mixed, columns, output, of_leaves).withColumnRenamed("id", id_column)


def lower_cased(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with texts lower-cased where 5 divides the CRC-32 of the id as text."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return manifest(docs, altered={"text": F.when(F.coalesce(hit, F.lit(False)), lower_cased(F.col("text"))).otherwise(F.col("text"))})
