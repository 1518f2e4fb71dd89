"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a rank queue: one bucket of positions per merge rank and a bitmap of the
buckets in use, in two levels, so that find-first-set picks the lowest rank in a few steps.
The parts form a linked list; an entry whose pair has changed since is stale and skipped.  All new
pre-tokens of a batch share one list and one queue, so a pre-token of n bytes costs O(n log n), however
long it is, and many short ones share the upkeep.

Null text counts as empty (no ids).  Extra columns are kept; each row is handled alone, so repeated rows
and rows without id give their own results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from harborline.llm.common import map_columns


LEAF = 8  # a leaf word of the bitmap has 2**LEAF bits, the summary word a bit for each leaf word
MASK = (1 << LEAF) - 1
WIDE = 32  # bits of the right part in a pair's key
LONGEST = 64
GAP, GONE = (1 << 31) - 1, -1  # marks between pre-tokens; swallowed parts


class Vocabulary:
    """Merge ranks of a byte-level vocabulary (bytes to id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}  # both parts' ids to the id of their union
        self.first = np.full(1 << 16, -1, np.int64)  # two bytes to that id
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    self.pairs[left << WIDE | right] = rank
            if len(whole) == 2:
                self.first[whole[0] << 8 | whole[1]] = rank

    def encode(self, piece: bytes) -> list[int]:
        return np.frombuffer(self.encode_all([piece])[0], "<u4").tolist()

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit words.

        The pre-tokens share one linked list, with gaps between them that no pair spans, and one queue.
        buckets: rank to positions; leaves: words of the bitmap of ranks in use; summary: leaf words in use.
        A union is longer than its parts, so a bucket gets nothing new while it is worked off.
        """
        text = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([0] + [len(p) + 1 for p in pieces])
        ids = self.byte_ids[text]
        ids[ends] = GAP
        rank = np.append(self.first[text[:-1].astype(np.int64) << 8 | text[1:]], -1)
        rank[ends] = -1
        rank[ends[1:] - 1] = -1
        part, rank_of = ids.tolist(), rank.tolist()
        follow, before = list(range(1, len(part) + 1)), list(range(-1, len(part)))
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        used, starts = np.unique(rank[at], return_index=True)
        buckets = {r: p.tolist() for r, p in zip(used.tolist(), np.split(at, starts[1:]))}
        leaves: dict[int, int] = {}
        summary = 0
        for r in used.tolist():
            leaves[r >> LEAF] = leaves.get(r >> LEAF, 0) | 1 << (r & MASK)
            summary |= 1 << (r >> LEAF)
        pair = self.pairs.get
        while summary:
            word = (summary & -summary).bit_length() - 1  # find first set, twice
            bits = leaves[word]
            lowest = bits & -bits
            leaves[word] = bits ^ lowest
            if bits == lowest:
                summary ^= 1 << word
            best = (word << LEAF) + lowest.bit_length() - 1
            bucket = buckets.pop(best)
            bucket.sort()
            for i in bucket:
                if rank_of[i] != best:
                    continue  # stale
                gone = follow[i]
                end = follow[i] = follow[gone]
                before[end] = i
                part[i], part[gone], rank_of[gone] = best, GONE, -1
                start = before[i]
                rank_of[i] = new = pair(best << WIDE | part[end], -1)
                rank_of[start] = left = pair(part[start] << WIDE | best, -1)
                for p, r in ((i, new), (start, left)):
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(p)
                        else:
                            buckets[r] = [p]
                            leaves[r >> LEAF] = leaves.get(r >> LEAF, 0) | 1 << (r & MASK)
                            summary |= 1 << (r >> LEAF)
        ids = np.array(part, np.int64)
        ids = ids[ids != GONE]
        gaps = np.flatnonzero(ids == GAP)
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a + 4 : 4 * b] for a, b in zip(gaps.tolist(), gaps[1:].tolist())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder:
    """Ids of texts.  Remembers short pre-tokens, in two generations: when the newer holds `most`, the
    older is forgotten, so that frequent pre-tokens stay.  Pre-tokens of more than LONGEST characters are not
    remembered, which bounds the memory, about 200 bytes a pre-token; it goes with the task."""

    def __init__(self, vocabulary: Vocabulary, most: int = 100_000):
        self.vocabulary, self.most = vocabulary, most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, tokens: Iterable[str]) -> None:
        if len(self.known) >= self.most:
            self.older, self.known = self.known, {}
        new = {t for t in tokens if t not in self.known}
        for t in [t for t in new if t in self.older]:
            self.known[t] = self.older[t]
            new.discard(t)
        order = list(new)
        coded = self.vocabulary.encode_all([t.encode("utf-8", "surrogatepass") for t in order])
        self.known.update(zip(order, coded))

    def texts(self, texts: list[str], pattern: str, at_once: int = 100_000) -> Iterator[bytes]:
        """Packed ids of each text; at most about at_once pre-tokens are held at a time."""
        find = regex.compile(pattern)
        batch: list[list[str]] = []
        held = 0
        for text in texts:
            if len(text) > at_once:
                yield from self.flush(batch)
                batch, held = [], 0
                matches = (m.group() for m in find.finditer(text))
                coded = []
                while part := list(islice(matches, at_once)):
                    coded.extend(self.flush([part]))
                yield b"".join(coded)
                continue
            batch.append(find.findall(text))
            held += len(batch[-1])
            if held >= at_once:
                yield from self.flush(batch)
                batch, held = [], 0
        yield from self.flush(batch)

    def flush(self, batch: list[list[str]]) -> Iterator[bytes]:
        if batch:
            self.learn(chain.from_iterable(batch))
        for tokens in batch:
            yield b"".join(map(self.known.__getitem__, tokens))
        if batch:
            for t in [t for t in self.known if len(t) > LONGEST]:
                del self.known[t]


def parse_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=2)
def _loaded(path: str) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary(parse_ranks(file.read().splitlines()))


def encode_decode(
    df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, ids: binary of little-endian 32-bit ids, n_tokens, decoded: binary).

    ranks_path is a rank file that every worker has (as an installed package or by --files); pattern is
    the pre-token pattern.  Each match of the pattern is encoded separately.
    """

    held: list[Encoder] = []  # a task's

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        if not held:
            held.append(Encoder(_loaded(ranks_path)))
        encoder = held[0]
        bytes_of = encoder.vocabulary.bytes_of.__getitem__
        for doc, coded in zip(ids, encoder.texts([t or "" for t in texts], pattern)):
            yield doc, coded, len(coded) // 4, b"".join(map(bytes_of, np.frombuffer(coded, "<u4").tolist()))

    kind = dict(df.dtypes)[id_column]
    return map_columns(df, [id_column, text_column], f"{id_column} {kind}, ids binary, n_tokens long, decoded binary", rows)


def round_trip_digests(
    df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Digest columns of encode_decode: id, n_tokens, ids_sha256, decoded_sha256."""
    from pyspark.sql import functions as F

    coded = encode_decode(df, ranks_path, pattern, id_column, text_column)
    return coded.select(
        id_column, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
