"""Removal of byte strings that repeat anywhere in a corpus, by induced suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.  How far the string at a
place repeats is told by the common prefix of its suffix with the neighbours in suffix order, so suffixes
are sorted with their common-prefix values, in shards that between them cover the corpus:

1. Sampled suffixes.  Of the core-grams in a string of `window` bytes, the one with the least hash (the
   leftmost, if tied) is the string's anchor.  Equal strings have equal anchors, so suffixes can be sorted
   within anchors of one hash.  An anchor whose hash occurs once cannot matter and goes first.
2. Classes.  Anchors with equal surroundings are one class with a count: all its strings repeat if the count
   is two or more.  Only one text excerpt of each class is read again, and only where a hash has several.
3. Induction.  Shards are dealt by hash; Spark's sort spills to disk, so a shard may be far larger than
   memory, and excerpts stream through by hash.  The suffixes at the anchors are sorted with their common
   prefixes.  From these the suffixes one byte earlier are induced, and so on back to the first start:
   tuples of (byte, rank of the suffix behind it) are sorted stably, and a pair's common prefix is one more
   than the least common prefix between their old ranks.
4. A hash with more than `crowd` classes, about 600 bytes each, would make one long group in one task.  Its
   strings, up to window - core + 1 a class, are counted by their 128-bit digests instead, which spread over all
   tasks and are added up before the shuffle.

The same values tell passages of `words` words or more that repeat and are shorter than `length`: words count
that a match holds whole, with the blanks before and after them, `window` bytes in all or more.  Passages are
reported beside the removal and stay in the text.

All in all every text is read three times, and no group is gathered whole: what a document's row holds is
bounded by the document.

Null texts count as empty.  Repeated rows repeat each other, with or without id.  Texts shorter than length
lose nothing.  Columns other than doc_id and the text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import dropped, map_columns, released, written

PLACES = 20  # bits for a place in a chunk
CHUNK = 1 << 19  # bytes hashed at a time
MOST_BROADCAST = 1_000_000
NO_ID = -(1 << 63)
WORD = re.compile(rb"[^ \t-\r]+")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value; powers of an odd base modulo 2**64, and of its inverse."""
    table = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    size = (1 << PLACES) + 1
    up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return table, np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes at each place."""
    table, up, down = _powers()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up[:n], out=sums[1:])
    h = (sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of `length` bytes in data its anchor's place; the hash of each place."""
    h = gram_hashes(data, core)
    packed = (h >> np.uint64(PLACES) << np.uint64(PLACES)) | np.arange(len(h), dtype=np.uint64)
    width, have, least = length - core + 1, 1, packed
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & np.uint64((1 << PLACES) - 1)).astype(np.int64), h


def segments(texts: list[bytes], window: int, core: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Runs of starts that share an anchor: (text index, text, rows of (anchor, first start, last start, hash)).

    A run that goes on in the next chunk of its text is one run: no suffix must meet itself.
    """
    held = None
    for i, text, rows in _chunks(texts, window, core):
        if held is not None and held[0] == i and held[2][-1, 0] == rows[0, 0]:
            held[2][-1, 2] = rows[0, 2]
            rows = rows[1:]
            if not len(rows):
                continue
        if held is not None:
            yield held
        held = i, text, rows
    if held is not None:
        yield held


def _chunks(texts: list[bytes], window: int, core: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """segments() of texts cut into chunks."""

    def flush(pieces: list[tuple[int, int]]) -> Iterator[tuple[int, bytes, np.ndarray]]:
        data = np.frombuffer(b"".join(texts[i][at : at + CHUNK + window - 1] for i, at in pieces), np.uint8)
        if len(data) < window:
            return
        place, h = anchors(data, window, core)
        begin = 0
        for i, at in pieces:
            size = min(CHUNK + window - 1, len(texts[i]) - at)
            mine = place[begin : begin + size - window + 1]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            last = np.append(first[1:], len(mine)) - 1
            p = mine[first]
            yield i, texts[i], np.stack([p - begin + at, first + at, last + at, h[p].view(np.int64)], axis=1)
            begin += size

    waiting, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - window + 1, CHUNK):
            size = min(CHUNK + window - 1, len(text) - at)
            if held + size > 2 * CHUNK - 1:
                yield from flush(waiting)
                waiting, held = [], 0
            waiting.append((i, at))
            held += size
    if waiting:
        yield from flush(waiting)


def induced(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """(c1, c2, low, high, end): at the distances from low to high before the anchor, the bytes up to `end`
    behind the anchor also stand elsewhere; only for `window` bytes or more.

    rows: whole hashes, with h, c1, c2, high (the largest distance of the class's starts) and piece, the
    bytes from the first start (high before the anchor) to the end of what is compared.
    """
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("c1", "c2", "low", "high", "end")})
    if not len(rows):
        return none
    high, h = rows["high"].to_numpy(np.int64), rows["h"].to_numpy(np.int64)
    pieces = list(rows["piece"])
    behind = [piece[k:] for piece, k in zip(pieces, high.tolist())]
    order = np.array(sorted(range(len(behind)), key=lambda i: (h[i], behind[i])), np.int64)
    group = np.cumsum(np.concatenate([[0], h[order][1:] != h[order][:-1]]))
    # common prefixes of neighbours
    width = max(map(len, behind))
    flat = np.zeros((len(behind), width), np.uint8)
    for r, i in enumerate(order):
        flat[r, : len(behind[i])] = np.frombuffer(behind[i], np.uint8)
    sizes = np.array([len(behind[i]) for i in order])
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differs = flat[1:] != flat[:-1]
        first = np.where(differs.any(1), differs.argmax(1), width)
        common[1:] = np.where(group[1:] == group[:-1], np.minimum(first, np.minimum(sizes[1:], sizes[:-1])), 0)
    ahead = np.zeros((len(pieces), int(high.max()) + 1), np.uint8)  # byte at each distance before the anchor
    for i, (piece, k) in enumerate(zip(pieces, high.tolist())):
        ahead[i, 1 : k + 1] = np.frombuffer(piece, np.uint8)[:k][::-1]
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    distance = 0
    while True:
        most = np.maximum(common, np.append(common[1:], 0))
        again = np.flatnonzero(most >= window)
        if len(again):
            hits.append((order[again], np.full(len(again), distance), most[again] - distance))
        distance += 1
        at = np.flatnonzero(high[order] >= distance)
        if len(at) < 2:
            break
        key = group[at] << 8 | ahead[order[at], distance]
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        fresh = np.zeros(len(at), np.int64)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(same):
            spans = np.stack([at[same - 1] + 1, at[same] + 1], axis=1).ravel()
            fresh[same] = 1 + np.minimum.reduceat(np.append(common, 0), spans)[::2]
        order, group, common = order[at], group[at], fresh
    if not hits:
        return none
    row, dist, end = (np.concatenate(x) for x in zip(*hits))
    turn = np.lexsort((dist, row))
    row, dist, end = row[turn], dist[turn], end[turn]
    breaks = (row[1:] != row[:-1]) | (dist[1:] != dist[:-1] + 1) | (end[1:] != end[:-1])
    starts = np.flatnonzero(np.concatenate([[True], breaks]))
    stops = np.append(starts[1:], len(row)) - 1
    of = lambda c: rows[c].to_numpy(np.int64)[row[starts]]
    return pd.DataFrame({"c1": of("c1"), "c2": of("c2"), "low": dist[starts], "high": dist[stops], "end": end[starts]})


def _halves(data: bytes, seed: int = 0) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(data, seed)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """id (null: NO_ID), text hash, text: rows equal in all are alike, so these are a document's key."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(t).alias("th"), t.alias("t"))


def _encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def repeated_ranges(docs: DataFrame, length: int, window: int, core: int, words: int, crowd: int, text: str = "text") -> DataFrame:
    """id, th, ranges: for each document with a repeated string, (a, z, e): from each place from a to z on, the
    bytes before e also stand elsewhere, `window` bytes or more; told for up to `length` bytes at least."""
    keyed = _keyed(docs, text)

    def found(ids: list, hashes: list, texts: list) -> Iterator[tuple]:
        for i, data, rows in segments(_encoded(texts), window, core):
            for p, first, last, h in rows.tolist():
                low, high = p - last, p - first
                piece = data[first : last + length]
                yield ids[i], hashes[i], p, low, high, len(piece) - high, h, *_halves(piece, low << 16 | high)

    kinds = "id long, th long, p long, low int, high int, end int, h long, c1 long, c2 long"
    every = written(map_columns(keyed, ["id", "th", "t"], kinds, found), "repeat-anchors")
    twice = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeat-hashes")
    small = twice.count() <= MOST_BROADCAST  # a checked size; more hashes are joined by a shuffle
    seen = written(every.join(F.broadcast(twice) if small else twice, "h", "left_semi"), "repeat-seen")
    dropped(every)
    place = F.struct("id", "th", "p", "low", "high", "end", "h")
    classes = seen.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("at")).select("c1", "c2", "n", "at.*")
    classes = written(classes, "repeat-classes")
    several = written(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "repeat-several")
    wanted = classes.join(several, "h").groupBy("id", "th").agg(
        F.collect_list(F.struct("h", "k", "c1", "c2", "n", "p", "low", "high", "end")).alias("places")
    )
    held = keyed.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"])  # one of repeated rows
    excerpt = written(_excerpts(held), "repeat-excerpts")

    def by_hash(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            whole = frame["h"] != frame["h"].iloc[-1]  # the last hash may go on in the next frame
            yield induced(frame[whole].reset_index(drop=True), window)
            held = frame[~whole]
        if held is not None:
            yield induced(held.reset_index(drop=True), window)
        released()

    kinds = "c1 long, c2 long, low long, high long, end long"
    few = excerpt.where(F.col("k") <= crowd).select("h", "c1", "c2", "high", "piece")
    sorted_in = few.repartition("h").sortWithinPartitions("h").mapInPandas(by_hash, kinds)
    runs = (
        classes.where("n > 1").select("c1", "c2", *[F.col(c).cast("long").alias(c) for c in ("low", "high", "end")])
        .unionByName(sorted_in)
        .unionByName(_counted(excerpt.where(F.col("k") > crowd), length, window, words))
    )
    ends = [(F.col("p") - F.col("r.high")).alias("a"), (F.col("p") - F.col("r.low")).alias("z"), (F.col("p") + F.col("r.end")).alias("e")]
    ranges = seen.alias("s").join(runs.alias("r"), ["c1", "c2"]).select("id", "th", F.struct(*ends).alias("range"))
    return ranges.groupBy("id", "th").agg(F.collect_set("range").alias("ranges"))


def _excerpts(joined: DataFrame) -> DataFrame:
    """The bytes of each wanted place."""

    def cut(texts: list, places: list) -> Iterator[tuple]:
        for data, wanted in zip(_encoded(texts), places):
            for w in wanted:
                yield w["h"], w["k"], w["c1"], w["c2"], w["n"], w["low"], w["high"], data[w["p"] - w["high"] : w["p"] + w["end"]]

    kinds = "h long, k long, c1 long, c2 long, n long, low int, high int, piece binary"
    return map_columns(joined, ["t", "places"], kinds, cut)


def _counted(excerpt: DataFrame, length: int, window: int, words: int) -> DataFrame:
    """Runs as of induced(), by digests of strings: of `length` bytes; of the words between blanks, `words` or
    more, that fill `window` bytes."""

    def strings(c1: list, c2: list, n: list, low: list, high: list, piece: list) -> Iterator[tuple]:
        for a, b, count, lo, hi, data in zip(c1, c2, n, low, high, piece):
            for d in range(lo, min(hi, len(data) + hi) + 1):
                string = data[hi - d : hi - d + length]
                if len(string) == length:
                    yield a, b, count, d, length - d, *_halves(string)
            spans = [m.span() for m in WORD.finditer(data)]
            end = words - 1
            for i in range(len(spans) - words + 1):
                at, end = spans[i][0] - 1, max(end, i + words - 1)
                while end < len(spans) and spans[end][1] + 1 - at < window:
                    end += 1
                if end == len(spans) or at > hi - lo:
                    break
                stop = spans[end][1] + 1
                if at >= 0 and stop <= len(data):
                    yield a, b, count, hi - at, stop - hi, *_halves(data[at:stop], 1)

    kinds = "c1 long, c2 long, n long, d long, end long, w1 long, w2 long"
    each = map_columns(excerpt, ["c1", "c2", "n", "low", "high", "piece"], kinds, strings)
    often = each.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").select("w1", "w2")
    return each.join(often, ["w1", "w2"], "left_semi").select("c1", "c2", F.col("d").alias("low"), F.col("d").alias("high"), "end")


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def whole_words(data: bytes, a: int, e: int) -> tuple[int, int, int]:
    """Words between blanks in data[a:e]: their count, the first one's start and the last one's stop."""
    spans = [m.span() for m in WORD.finditer(data, a, e)]
    if spans and spans[0][0] == a:
        spans = spans[1:]
    if spans and spans[-1][1] == e:
        spans = spans[:-1]
    return (len(spans), spans[0][0], spans[-1][1]) if spans else (0, a, a)


def without_repeats(
    docs: DataFrame, length: int = 400, window: int = 200, core: int = 48, words: int = 49, crowd: int = 50_000, text: str = "text"
) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans, n_passages, n_passage_bytes for each row.

    Passages are maximal runs of bytes in repeated strings of `length` bytes or in `words` words that repeat:
    a passage of over 50 words holds 49 whole ones wherever other text may touch its ends.
    """
    if not core < window <= length:
        raise ValueError("core < window <= length is asked for")
    ranges = repeated_ranges(docs, length, window, core, words, crowd, text)
    keyed = _keyed(docs, text).withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    joined = keyed.join(ranges, ["id", "th"], "left")

    def cut(ids: list, texts: list, found: list) -> Iterator[tuple]:
        for doc, data, ranges in zip(ids, _encoded(texts), found):
            gone, told = [], []
            for r in ranges or ():
                a, z, e = r["a"], min(r["z"], r["e"] - length), r["e"]
                if a <= z:  # its words are removed as well, here or from the places that follow
                    gone.append((a, z + length))
                    continue
                n, first, last = whole_words(data, a, e)
                if n >= words and last - first + 2 >= window:
                    told.append((first, last))
            gone = united(gone)
            passages = united(gone + told)
            edges = [0, *(x for r in gone for x in r), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            yield doc, kept, len(data), len(data) - len(kept), len(gone), len(passages), sum(b - a for a, b in passages)

    kinds = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, n_passages long, n_passage_bytes long"
    return map_columns(joined, ["doc_id", "t", "ranges"], kinds, cut)


def removal_digests(docs: DataFrame, length: int = 400) -> DataFrame:
    found = without_repeats(docs, length)
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_bytes"
    )
