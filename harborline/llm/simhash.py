"""Near-duplicates by SimHash fingerprints, found through the Golay code.

A fingerprint's 64 bits are cut into four blocks of 16.  Of two fingerprints that differ in three bits or
fewer, one block is equal (pigeonhole), and of the two halves of the other 48 bits one differs in one bit
or fewer.  23 bits of that half are decoded to the index of the nearest codeword of the perfect (23, 12)
Golay code, as are the 23 words one bit away: about five distinct indices.  Words at distance one share an
index, so equal block, half and index make a key that such a pair shares for certain.  Pairs within a key
are then verified on all 64 bits.

Equal fingerprints are one node.  Keys with few members are compared in sorted runs; keys with more than
`crowd` members are dealt into tiles and every pair of tiles is a group of its own, so no task holds an
unbounded key, and each tile pair only emits a spanning forest of its links: fewer links than nodes.
Components of these links are those of all links.

Null and empty texts have no shingle and fingerprint zero.  A node is a fingerprint, so rows without id link others as
any row does, and rows of one id with different texts are no link; a component is named by its least id, and has
no name (null) if no row of it has an id.  Repeated rows give repeated results, an empty table an empty one.  Columns
other than doc_id and text are not read.  near_copies() leaves rows without id out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.common import map_columns, released, written
from harborline.llm.components import components

SEED = 42
MOST_LEADERS = 2000
CODE, CHECKS = 23, 11
GENERATOR = 0b110001110101  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text; only A-Z are lower-cased and only ASCII blanks part words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row."""

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        for doc, value in zip(ids, texts):
            fp = fingerprint(shingle_hashes(value, words))
            yield doc, fp - (1 << 64) if fp >> 63 else fp

    return map_columns(docs, ["doc_id", text], f"doc_id {dict(docs.dtypes)['doc_id']}, fp long", rows)


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 23-bit word's upper bits by the generator; error word of each remainder."""
    upper = np.zeros(1 << (CODE - CHECKS), np.int64)
    for bit in range(CODE - CHECKS):
        rest = 1 << (bit + CHECKS)
        for k in range(CODE - 1, CHECKS - 1, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << (k - CHECKS)
        upper[1 << bit : 2 << bit] = upper[: 1 << bit] ^ rest
    errors = np.zeros(1 << CHECKS, np.int64)
    one = 1 << np.arange(CODE)
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    for e in (*one, *two, *three):
        errors[upper[e >> CHECKS] ^ (e & ((1 << CHECKS) - 1))] = e
    return upper, errors


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """Index (upper 12 bits) of the codeword nearest to each 23-bit word."""
    upper, errors = _golay()
    remainder = upper[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))
    return (words ^ errors[remainder]) >> CHECKS


def nearby_codewords(words: np.ndarray, bits: int = CODE) -> np.ndarray:
    """For each word the indices of its own and its neighbours' codewords, a row each; only the low bits vary."""
    return np.stack([nearest_codeword(words), *(nearest_codeword(words ^ (1 << bit)) for bit in range(bits))], axis=1)


def golay_keys(fps: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints of `width` bits (uint64), and the place in fps of each key; none repeats for a place.

    width: a multiple of 8; a block has a quarter of the bits, a half the half of the rest.
    """
    block, half = width // 4, 3 * width // 8
    bits = min(CODE, half)
    keys, places = [], []
    for b in range(4):
        equal = (fps >> np.uint64(block * b)) & np.uint64((1 << block) - 1)
        low = fps & np.uint64((1 << (block * b)) - 1)
        high = (fps >> np.uint64(block * b + block)) << np.uint64(block * b) if b < 3 else np.zeros_like(fps)
        rest = low | high
        for h in range(2):
            word = ((rest >> np.uint64(half * h)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            near = np.sort(nearby_codewords(word, bits), axis=1)
            fresh = np.ones(near.shape, bool)
            fresh[:, 1:] = near[:, 1:] != near[:, :-1]
            row, column = np.nonzero(fresh)
            keys.append(((np.int64(b * 2 + h) << block | equal[row].astype(np.int64)) << 12) | near[row, column])
            places.append(row)
    return np.concatenate(keys), np.concatenate(places)


def _forest(a: np.ndarray, b: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between a and b (uint64), or within a if they are the same tile.

    Grown breadth first: nodes that one comparison reaches leave the pool, so the links emitted are fewer
    than the nodes.
    """
    nodes = np.unique(np.concatenate([a, b]))
    links, pool = [], np.ones(len(nodes), bool)
    while pool.any():
        start = int(np.flatnonzero(pool)[0])
        pool[start] = False
        queue = [start]
        while queue:
            here = queue.pop()
            rest = np.flatnonzero(pool)
            near = rest[np.bitwise_count(nodes[rest] ^ nodes[here]) <= bits]
            pool[near] = False
            links.extend((int(nodes[here]), int(nodes[k])) for k in near)
            queue.extend(near.tolist())
    return links


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


LANE = 40  # bits of a key below its lane


def lane_links(nodes: DataFrame, widths: dict[int, int], bits: int = 3, crowd: int = 256) -> DataFrame:
    """Edges (lane, a, b) between the distinct fingerprints of each lane of nodes (lane int, fp long) that join all
    within `bits` bits; all lanes in one pass.

    widths: bits of each lane's fingerprints; bits: 3 or fewer.
    """
    if bits > 3:
        raise ValueError("the keys only cover three differing bits")

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lanes, fps = frame["lane"].to_numpy(np.int64), frame["fp"].to_numpy(np.int64)
            for lane in np.unique(lanes).tolist():
                mine = fps[lanes == lane]
                key, place = golay_keys(mine.view(np.uint64), widths[lane])
                yield pd.DataFrame({"key": key | lane << LANE, "fp": mine[place]})

    keys = nodes.select("lane", "fp").mapInPandas(keyed, "key long, fp long")
    crowded = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    crowded = written(crowded, "crowded")

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Compare each row with those after it of the same key; rows come sorted by key."""
        held = np.zeros((2, 0), np.int64)
        for frame in frames:
            both = np.concatenate([held, frame[["key", "fp"]].to_numpy(np.int64).T], axis=1)
            key = both[0]
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next frame
            yield compared(both[:, :last])
            held = both[:, last:]
        yield compared(held)
        released()

    def compared(rows: np.ndarray) -> pd.DataFrame:
        """Pairs of small keys; of larger ones a spanning forest, so that links do not grow with its square."""
        key, fp = rows[0], rows[1].astype(np.int64).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        size_of = np.repeat(sizes, sizes)
        found = [np.zeros((3, 0), np.uint64)]
        lane = (key >> LANE).astype(np.uint64)
        for i, n in zip(starts[sizes > 4].tolist(), sizes[sizes > 4].tolist()):
            tree = np.array(_forest(fp[i : i + n], fp[:0], bits), np.uint64).reshape(-1, 2).T
            found.append(np.concatenate([np.full((1, tree.shape[1]), lane[i]), tree]))
        at = np.flatnonzero((size_of > 1) & (size_of <= 4))
        for step in (1, 2, 3):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
            found.append(np.stack([lane[near], fp[near], fp[near + step]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pd.DataFrame({"lane": both[0].astype(np.int32), "a": _signed(both[1]), "b": _signed(both[2])})

    schema = "lane int, a long, b long"
    few = keys.join(crowded.select("key"), "key", "left_anti").repartition("key").sortWithinPartitions("key")
    near = few.mapInPandas(runs, schema)

    tiles = F.ceil(F.col("n") / F.lit(4 * crowd)).cast("int")
    dealt = keys.join(crowded, "key").withColumn("tiles", tiles)
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), "t", "fp")

    def tile_pair(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        left = (group["t"] == group["i"]).to_numpy()
        found = np.array(_forest(fp[left], fp[~left], bits), np.uint64).reshape(-1, 2)
        return pd.DataFrame({"lane": np.int32(group["key"].iloc[0] >> LANE), "a": _signed(found[:, 0]), "b": _signed(found[:, 1])})

    crowds = dealt.groupBy("key", "i", "j").applyInPandas(tile_pair, schema)
    return near.unionByName(crowds).select("lane", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(nodes: DataFrame, bits: int = 3, crowd: int = 256, width: int = 64) -> DataFrame:
    """lane_links() of one lane: edges (a, b) of nodes (fp)."""
    return lane_links(nodes.select(F.lit(0).alias("lane"), "fp"), {0: width}, bits, crowd).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, null if there is none) for each row."""
    prints = written(fingerprints(docs, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least")), "nodes")
    edges = links(nodes, bits)
    found = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    roots = placed.join(names, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(roots, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


LONG_WORD, LANES, LANE_WIDTH = 5, 3, 48


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of each hash."""
    x = h ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def alike_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Spanning forest, as places in sets, of the pairs whose exact Jaccard similarity reaches `least`.

    sets: sorted distinct hashes each; two empty ones are alike.  Grown breadth first over links that pass,
    and a node leaves the pool only when it is linked, so no pair is left untested that could join two trees.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    ids = np.append(ids, ids.max(initial=-1) + 1)  # a place that is never marked, for empty sets at the end
    mark = np.zeros(int(ids[-1]) + 1, bool)
    found, pool = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not pool[start]:
            continue
        pool[start] = False
        queue = [start]
        while queue:
            here = queue.pop()
            rest = np.flatnonzero(pool)
            low, high = np.minimum(sizes[rest], sizes[here]), np.maximum(sizes[rest], sizes[here])
            rest = rest[low >= least * high - 1e-9]  # sizes alone rule the others out
            if not len(rest):
                continue
            mine = ids[starts[here] : stops[here]]
            mark[mine] = True
            if len(rest) <= 16:
                common = np.array([mark[ids[starts[k] : stops[k]]].sum() for k in rest])
            else:
                running = np.concatenate([[0], np.cumsum(mark[ids], dtype=np.int64)])
                common = running[stops[rest]] - running[starts[rest]]
            mark[mine] = False
            near = rest[common >= least * (sizes[rest] + sizes[here] - common) - 1e-9]
            pool[near] = False
            found.extend((here, int(k)) for k in near)
            queue.extend(near.tolist())
    return found


def _lanes(texts: DataFrame) -> DataFrame:
    """node and lane fingerprints (array of long) for each row of (node, text).

    The first lane is the 64-bit fingerprint of 3-word shingles; the others, of LANE_WIDTH bits, are of the
    distinct words of LONG_WORD bytes or more (all words, if few are), under hashes of their own: words stay
    when an edit breaks five shingles, so these lanes find copies that the first one misses.
    """

    def rows(nodes: list, values: list) -> Iterator[tuple]:
        for node, text in zip(nodes, values):
            parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
            words = {w for w in parts if len(w) >= LONG_WORD}
            words = words if len(words) >= 8 else set(parts)
            h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
            fps = [fingerprint(shingle_hashes(text, 3))]
            fps += [fingerprint(_mixed(h, lane)) & (1 << LANE_WIDTH) - 1 for lane in range(LANES)]
            yield node, [f - (1 << 64) if f >> 63 else f for f in fps]

    return map_columns(texts, ["node", "text"], "node long, fps array<long>", rows)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    place = np.searchsorted(a, b)
    common = int((a[np.minimum(place, len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _tiled(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    return rows.join(sizes, "component").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))


def _around_leader(rest: DataFrame, big: DataFrame, least: float, tile: int) -> tuple[list[DataFrame], DataFrame]:
    """Links of the least node of each big block, and of the nodes close to it; the block's other nodes.

    Distance, 1 less similarity, is a metric.  With r the most that links, nodes within r / 2 of the leader
    are joined by it, and only nodes from r to 3r / 2 from it could have a link to one of them alone: those
    are compared with all of them, so both kinds are done.  A block of copies of one text leaves few.
    """
    leaders = rest.join(big, "component").where("node = leader").select("component", "leader", F.col("shingles").alias("__led"))
    leaders = F.broadcast(leaders) if big.count() <= MOST_LEADERS else leaders  # a checked size

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            far = [1 - similarity(_set(a), _set(b)) for a, b in zip(frame["__led"], frame["shingles"])]
            yield frame[["node", "component", "leader"]].assign(far=np.array(far, float))

    schema = "node long, component long, leader long, far double"
    placed = rest.join(leaders, "component").select("node", "component", "leader", "shingles", "__led").mapInPandas(measured, schema)
    placed = written(placed, "near-placed")
    r, eps = 1 - least, 1e-9
    linked = placed.where((F.col("far") <= r + eps) & (F.col("node") != F.col("leader"))).select(F.col("leader").alias("u"), F.col("node").alias("v"))
    kind = F.when(F.col("far") <= r / 2 + eps, 0).when((F.col("far") > r + eps) & (F.col("far") <= 1.5 * r + eps), 1)
    done = placed.where(F.col("far") <= r / 2 + eps).select("node")
    of = placed.select("node", kind.alias("kind")).where("kind IS NOT NULL")
    sizes = placed.where(F.col("far") <= r / 2 + eps).groupBy("component").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    some = placed.where(kind == 1).select("component").distinct()  # without a ring there is nothing to compare
    both = _tiled(rest.join(some, "component", "left_semi").join(of, "node"), sizes)
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    both = both.withColumn("t", F.explode(F.when(F.col("kind") == 0, F.array("t")).otherwise(every)))

    def ringed(group: pd.DataFrame) -> pd.DataFrame:
        inner, ring = group[group["kind"] == 0], group[group["kind"] == 1]
        sets = [_set(s) for s in inner["shingles"]]
        found = []
        for node, data in zip(ring["node"], ring["shingles"]):
            mine = _set(data)
            hit = next((k for k, s in enumerate(sets) if similarity(s, mine) >= least - eps), None)
            if hit is not None:
                found.append((int(inner["node"].iloc[hit]), node))
        return pd.DataFrame(found, columns=["u", "v"]).astype(np.int64)

    beside = both.select("component", "t", "kind", "node", "shingles").groupBy("component", "t").applyInPandas(ringed, "u long, v long")
    return [linked, beside], rest.join(done, "node", "left_anti")


def alike_in_blocks(texts: DataFrame, blocks: DataFrame, least: float, tile: int = 512, rounds: int = 4) -> DataFrame:
    """Links (u, v) that join all nodes of a block whose exact similarity reaches `least`.

    texts: node, text; blocks: node, component.  Blocks of more than `tile` nodes first shed what lies close to a
    leader, while that takes half of any of them, `rounds` times at most.  Every two of the nodes left in a
    block meet: large rests are dealt into tiles, and every pair of tiles is a group of its own.
    """

    def rows(nodes: list, components: list, values: list) -> Iterator[tuple]:
        for node, component, text in zip(nodes, components, values):
            yield node, component, np.unique(shingle_hashes(text, 5)).tobytes()

    schema = "node long, component long, shingles binary"
    sets = written(map_columns(blocks.join(texts, "node"), ["node", "component", "text"], schema, rows), "near-sets")
    counted = lambda df: df.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("leader"))
    found: list[DataFrame] = []
    big = written(counted(sets).where(F.col("n") > tile), "near-big")
    rest = sets
    for _ in range(rounds):
        if big.isEmpty():
            break
        more, rest = _around_leader(rest, big.select("component", "leader"), least, tile)
        found += [written(m, "near-links") for m in more]
        rest = written(rest, "near-rest")
        now = counted(rest).where(F.col("n") > tile)
        before = big.select("component", F.col("n").alias("__n"))
        big = written(now.join(before, "component").where(2 * F.col("n") <= F.col("__n")).select("component", "n", "leader"), "near-big")
    sizes = rest.groupBy("component").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = _tiled(rest, sizes).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("component", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), "node", "shingles")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy(np.int64)
        pairs = np.array(alike_forest([_set(s) for s in group["shingles"]], least), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": nodes[pairs[:, 0]], "v": nodes[pairs[:, 1]]})

    out = dealt.groupBy("component", "i", "j").applyInPandas(linked, "u long, v long")
    for part in found:
        out = out.unionByName(part)
    return out


def near_copies(docs: DataFrame, least: float = 0.8, bits: int = 3) -> DataFrame:
    """doc_id, component_id and h, the text's digest: groups of documents whose 5-word shingles are similar to
    `least` or more.

    Equal texts are one node.  In every lane, equal fingerprints are linked to their least node, and
    fingerprints within `bits` bits by the Golay keys.  Components of these links are blocks; within a block
    all pairs are decided by the exact Jaccard similarity of their shingles' hashes, so spanning forests are
    enough for the first step and lose no pair in the second.
    """
    h = F.md5(F.coalesce("text", F.lit("")))
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"))
    texts = written(keyed.groupBy("h").agg(F.min("doc_id").alias("first")), "texts")
    shared = not texts.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if shared:  # an id with several texts: all but one of them get a name of their own
        place = F.row_number().over(Window.partitionBy("first").orderBy("h"))
        own = F.shiftright(F.xxhash64("h"), 2) + F.lit(-(1 << 62))
        texts = written(texts.withColumn("node", F.when(place == 1, F.col("first")).otherwise(own)), "texts")
    else:
        texts = texts.withColumn("node", F.col("first"))
    named = docs.select(F.col("doc_id").cast("long").alias("first"), "text", h.alias("h"))
    named = named.join(texts, ["first", "h"]).select("node", "text")
    lanes = _lanes(named.select("node", "text")).select("node", F.posexplode("fps").alias("lane", "fp"))
    lanes = written(lanes, "lanes")
    nodes = written(lanes.groupBy("lane", "fp").agg(F.min("node").alias("first")), "lane-nodes")
    equal = lanes.join(nodes, ["lane", "fp"]).where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = lane_links(nodes, {0: 64} | {k: LANE_WIDTH for k in range(1, 1 + LANES)}, bits)
    near = near.join(nodes.select("lane", F.col("fp").alias("a"), F.col("first").alias("u")), ["lane", "a"])
    near = near.join(nodes.select("lane", F.col("fp").alias("b"), F.col("first").alias("v")), ["lane", "b"]).select("u", "v")
    blocks = written(components(equal.unionByName(near)), "blocks")
    held = named.join(blocks, "node", "left_semi").dropDuplicates(["node"])
    groups = components(alike_in_blocks(held, blocks, least))
    rooted = texts.join(groups, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    if shared:
        named_by = rooted.groupBy("component_id").agg(F.min("first").alias("__least"))
        rooted = rooted.join(named_by, "component_id").withColumn("component_id", F.col("__least"))
    rooted = rooted.select("h", "component_id")
    return keyed.join(rooted, "h").select("doc_id", "component_id", "h")


def representatives(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs without all but one row of each group of near copies: the row of the smallest doc_id stays.

    Decided by id and text, so a row that shares its id with a copy, but not its text, stays.  Of rows repeated
    with id and text one stays.  Rows without id cannot be named and all stay.
    """
    if "__h" in docs.columns:
        raise ValueError("__h is a column already")
    grouped = written(near_copies(docs, least), "near-copies")
    keyed = docs.withColumn("__h", F.md5(F.coalesce("text", F.lit(""))))
    row = [F.col("doc_id").cast("long").alias("__id"), F.col("h").alias("__h")]
    removed = grouped.where(F.col("component_id") != F.col("doc_id")).select(*row).distinct()
    kept = keyed.withColumn("__id", F.col("doc_id").cast("long")).join(removed, ["__id", "__h"], "left_anti")
    repeated = written(grouped.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(*row), "repeated-rows")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"])
    return kept.join(repeated, ["__id", "__h"], "left_anti").unionByName(once).select(*docs.columns)
