"""Benchmark decontamination by latent semantic retrieval.

1. Passages.  Every whole document is cut into blocks of `block` words; a passage is two neighbouring
   blocks, so a passage starts every block.  Its terms are the benchmark's words, weighed by TF-IDF with the
   block frequencies of the whole corpus; every word has a positive weight.  Words in over `common` of all
   blocks are left out of the search, but for those of a piece that would keep less than `rare` of its weight.
2. Latent space.  A randomised SVD of the passage matrix A: the range finder starts from random mixtures of
   the benchmark's own vectors, Z = A'(A Omega) is summed over all passages by Spark, and the singular
   vectors and values follow from Z; those of small values are cut off.
3. Search.  Cosines of all passages and all benchmark pieces in that space, as matrix products by batch; a
   passage at `near` or more that holds `held` of the piece's squared weight is a candidate for its item; of
   pieces of common words, which other words outweigh, every passage that holds so much.
4. Checks.  Longest common subsequence of the candidate's surroundings and the item, in words, as a share
   of the item; and the share of the item's answer (its last sentence) found there.  A document is
   contaminated by an item if the words found carry `told` of the item's IDF weight and the subsequence
   covers `sure` of it, or covers `likely` of it and the answer is found to `answered`.  Items under `short` words must be there in full.
   Common words meet by chance in a long surrounding, so an item with less than `rare` of its weight in rarer
   words must reach `sure` in a stretch half as long again as itself, or `likely` there with the answer and
   `short` words verbatim; under `short` words it must stand there verbatim.

The benchmark is worked off in blocks of at most about `items_at_once` items, so that what is broadcast is
bounded; the corpus never is.  Null and empty texts, and items without words, match nothing; repeated rows of
documents are reported each, repeated rows of the benchmark once; items without id are searched like others.
Columns other than doc_id, item_id and the texts are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import map_columns, written

#: ASCII but letters and digits parts words.
BLANKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: At most so many tasks send a summary of their documents.
SUMMARIES = 4096
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANKS).split()


def laid_out(documents: Iterable[bytes], block: int, at_once: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents' word ids end to end, about at_once words at a time: (first document's number, ids, starts, stops).

    Each document starts at a block's start after an empty block, so no passage spans two of them.
    """
    held: list[np.ndarray] = []
    first, size = 0, 0
    for number, data in enumerate(documents):
        held.append(np.frombuffer(data, np.int32))
        size += len(held[-1])
        if size >= at_once:
            yield first, *_laid(held, block)
            held, first, size = [], number + 1, 0
    if held:
        yield first, *_laid(held, block)


def _laid(docs: list[np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(d) for d in docs])
    room = (-(-lengths // block) + 1) * block
    starts = block + np.concatenate([[0], np.cumsum(room)[:-1]])
    ids = np.full(block + room.sum(), -1, np.int32)
    for d, a in zip(docs, starts.tolist()):
        ids[a : a + len(d)] = d
    return ids, starts, starts + lengths


@dataclass
class Benchmark:
    """A block of items as word ids, cut into pieces."""

    items: list  # item ids
    words: list[list[int]]
    answers: list[list[int]]
    vocabulary: dict[bytes, int]
    pieces: list[tuple[int, list[int]]]  # place of the item, word ids

    @classmethod
    def of(cls, rows: list[tuple], piece: int) -> Benchmark:
        vocabulary: dict[bytes, int] = {}
        items, words, answers, pieces = [], [], [], []
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            if not ids:
                continue
            sentences = [s for s in SENTENCE.split(text.strip()) if words_of(s)]
            tail = [vocabulary[w] for w in words_of(sentences[-1])] if len(sentences) > 1 else ids[-max(1, len(ids) // 4) :]
            cuts = max(1, math.ceil(len(ids) / piece))
            for c in range(cuts):
                pieces.append((len(items), ids[len(ids) * c // cuts : len(ids) * (c + 1) // cuts]))
            items.append(item)
            words.append(ids)
            answers.append(tail)
        return cls(items, words, answers, vocabulary, pieces)

    def vectors(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces x words, each row of length one (or zero); the rows' lengths before."""
        m = np.zeros((len(self.pieces), len(self.vocabulary)), np.float32)
        for r, (_, ids) in enumerate(self.pieces):
            np.add.at(m[r], ids, 1.0)
        m *= idf
        size = np.maximum(np.linalg.norm(m, axis=1), 1e-12)
        return m / size[:, None], size


def run_sums(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at start.

    Most runs are short: adding their second rows, their third rows and so on takes whole rows at a time, many
    times faster than reduceat over the first axis.
    """
    lengths = np.diff(np.append(start, len(rows)))
    if lengths.max() > 512:
        return np.add.reduceat(rows, start, axis=0)
    out = rows[start]
    k, some = 1, np.flatnonzero(lengths > 1)
    while len(some):
        out[some] += rows[start[some] + k]
        k += 1
        some = some[lengths[some] > k]
    return out


def passages(ids: np.ndarray, idf: np.ndarray, basis: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of laid-out word ids (-1: not in the benchmark): places and ids of the weighing words; the blocks
    they stand in; the projections of the passages that start at each block from the first of them on."""
    at = np.flatnonzero(ids >= 0)
    at = at[idf[ids[at]] > 0]
    used = ids[at]
    blocks = at // block
    rows, start = np.unique(blocks, return_index=True)
    if not len(rows):
        return at, used, rows, np.zeros((0, basis.shape[1]), np.float32)
    sums = run_sums(basis[used] * idf[used, None], start)
    return at, used, rows, sums


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := masks.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def longest_run(a: list[int], b: list[int]) -> int:
    """Length of the longest run of words that both have verbatim."""
    best, row = 0, [0] * (len(a) + 1)
    for x in b:
        row = [0, *(row[i] + 1 if a[i] == x else 0 for i in range(len(a)))]
        best = max(best, max(row))
    return best


def dense_subsequence(a: list[int], b: list[int]) -> int:
    """Longest common subsequence of a and any stretch of b half as long again as a, to a quarter of a's length."""
    size, step = -(-3 * len(a) // 2), max(1, len(a) // 4)
    return max(common_subsequence(a, b[i : i + size]) for i in range(0, max(1, len(b) - size + step), step))


def weights(bench: Benchmark, seen: np.ndarray, total: int, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words' weights; their weights in the search; which pieces and which items are of common words."""
    full = np.log1p((total + 1.0) / (seen + 1.0)).astype(np.float32)
    rarer = np.where(seen <= max(1.0, limits.common * total), full, 0.0)
    weak = lambda ids: bool(rarer[ids].sum() < limits.rare * full[ids].sum())
    weak_pieces = np.array([weak(ids) for _, ids in bench.pieces])
    search = rarer.astype(np.float32)
    for (_, ids), is_weak in zip(bench.pieces, weak_pieces):
        if is_weak:
            search[ids] = full[ids]
    return full, search, weak_pieces, np.array([weak(ids) for ids in bench.words])


def _ids_table(docs: DataFrame, vocabulary, extra: list[str]) -> DataFrame:
    """The documents' word ids, as 32-bit words; only documents with a word of the vocabulary."""
    kinds = dict(docs.dtypes)

    def rows(*columns: list) -> Iterator[tuple]:
        get = vocabulary.value.get
        for *others, text in zip(*columns):
            found = words_of(text)
            ids = np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))
            if (ids >= 0).any():
                yield (*others, ids.tobytes())

    schema = ", ".join(f"{c} {kinds[c]}" for c in extra) + ", ids binary"
    return map_columns(docs, [*extra, "text"], schema, rows)


def _block_counts(ids: DataFrame, size: int, block: int) -> tuple[np.ndarray, int]:
    """Blocks that hold each word, and blocks in all."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, blocks = np.zeros(size, np.int64), 0
        for frame in frames:
            for data in frame["ids"]:
                doc = np.frombuffer(data, np.int32)
                blocks += -(-len(doc) // block)
                at = np.flatnonzero(doc >= 0)
                pairs = np.unique((at // block) * size + doc[at])
                seen += np.bincount(pairs % size, minlength=size)
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"word": np.append(used, -1), "n": np.append(seen[used], blocks)})

    rows = ids.select("ids").coalesce(SUMMARIES).mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(size, np.int64), 0
    for r in rows:
        if r.word < 0:
            total = r.n
        else:
            out[r.word] = r.n
    return out, total


def latent_basis(ids: DataFrame, start: np.ndarray, idf: np.ndarray, block: int) -> np.ndarray:
    """Singular vectors of the TF-IDF passages A of all documents, from one pass that sums A'(A start)."""
    shared = ids.sparkSession.sparkContext.broadcast((start.astype(np.float32), idf.astype(np.float32)))

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omega, weight = shared.value
        z = np.zeros(omega.shape, np.float32)
        for frame in frames:
            for _, ids, _, _ in laid_out(frame["ids"], block):
                at, used, rows, sums = passages(ids, weight, omega, block)
                if not len(rows):
                    continue
                # a word in block r is in passages r - 1 and r, which also hold blocks r - 1 and r + 1
                near = np.zeros_like(sums)
                follows = np.flatnonzero(rows[1:] == rows[:-1] + 1)
                near[follows] += sums[follows + 1]
                near[follows + 1] += sums[follows]
                row = np.searchsorted(rows, at // block)
                turn = np.argsort(used, kind="stable")
                words, first = np.unique(used[turn], return_index=True)
                gain = (2 * sums + near)[row[turn]] * weight[used[turn], None]
                z[words] += run_sums(gain, first)
        touched = np.flatnonzero(z.any(1))
        yield pd.DataFrame({"word": touched, "z": pd.Series([row.tobytes() for row in z[touched]], dtype=object)})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        words, row = np.unique(frame["word"].to_numpy(np.int64), return_inverse=True)
        total = np.zeros((len(words), start.shape[1]), np.float32)
        np.add.at(total, row, np.stack([np.frombuffer(data, np.float32) for data in frame["z"]]))
        return pd.DataFrame({"word": words, "z": [r.tobytes() for r in total]})

    parts = ids.select("ids").coalesce(SUMMARIES).mapInPandas(sketch, "word long, z binary")
    z = np.zeros(start.shape, np.float64)
    for r in parts.groupBy(F.pmod("word", F.lit(64))).applyInPandas(added, "word long, z binary").toLocalIterator():
        z[r.word] = np.frombuffer(r.z, np.float32)
    shared.unpersist()
    return singular_basis(z, start)


def singular_basis(z: np.ndarray, start: np.ndarray, least: float = 1e-4) -> np.ndarray:
    """Right singular vectors of A from z = A'(A start), start having orthonormal columns.

    Nystroem's form of the randomised SVD: with a shift, A'A is about z (start' z)^-1 z', whose singular vectors
    follow from a Cholesky factor.  The shift keeps the start in the space, so that items no passage
    resembles keep a direction; vectors below `least` of the largest singular value are cut off.
    """
    z = z / max(1e-12, np.linalg.norm(z)) + 1e-3 * start
    core = start.T @ z
    root = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.eye(len(core)))
    u, values, _ = np.linalg.svd(np.linalg.solve(root, z.T).T, full_matrices=False)
    return np.ascontiguousarray(u[:, values >= least * values[0]]).astype(np.float32)


@dataclass(frozen=True)
class Limits:
    block: int = 32
    piece: int = 40
    common: float = 0.02
    rare: float = 0.5
    near: float = 0.35
    held: float = 0.3
    sure: float = 0.75
    likely: float = 0.55
    answered: float = 0.6
    told: float = 0.5
    short: int = 8
    dimensions: int = 128


def _matches(
    documents: list[bytes], bench: Benchmark, full: np.ndarray, idf: np.ndarray, weak_pieces: np.ndarray, weak: np.ndarray,
    basis: np.ndarray, pieces: np.ndarray, sizes: np.ndarray, limits: Limits,
) -> Iterator[tuple]:
    """(document's number, item's place, cosine, share of the common subsequence, share of the answer).

    full, idf, weak_pieces, weak: as of weights(); pieces: unit vectors in the latent space; sizes: the pieces'
    lengths there before.
    """
    weight_of = [float(sum(full[w] for w in words)) for words in bench.words]
    near = np.where(weak_pieces, 0.0, limits.near).astype(np.float32)
    for number, doc, opens, closes in laid_out(documents, limits.block):
        _, _, rows, sums = passages(doc, idf, basis, limits.block)
        if not len(rows):
            continue
        # a passage also starts one block before each used block
        starts = np.unique(np.concatenate([rows, rows - 1]))
        vectors = np.zeros((len(starts), basis.shape[1]), np.float32)
        vectors[np.searchsorted(starts, rows)] += sums
        vectors[np.searchsorted(starts, rows - 1)] += sums
        length = np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-12)
        some = np.flatnonzero(length >= limits.held * sizes.min())  # a dot product is at most this length
        starts, vectors, length = starts[some], vectors[some], length[some]
        best: dict[tuple[int, int], tuple] = {}
        for part in range(0, len(starts), 4096):
            dots = vectors[part : part + 4096] @ pieces.T
            floor = np.maximum(near * length[part : part + 4096, None], limits.held * sizes)
            for r, c in zip(*np.nonzero(dots >= floor)):
                at = int(starts[part + r]) * limits.block
                # of a passage that starts in the empty block before a document, the document
                d = max(0, int(np.searchsorted(opens, at + limits.block, "right")) - 1)
                item = bench.pieces[c][0]
                words = bench.words[item]
                region = doc[max(at - len(words), int(opens[d])) : min(at + 2 * limits.block + len(words), int(closes[d]))]
                verbatim = region.tolist()
                region = region[region >= 0].tolist()
                there = set(region)
                # what the words found tell: common words alone do not make a match
                told = float(sum(full[w] for w in words if w in there)) / max(1e-9, weight_of[item])
                if told < limits.told:
                    continue
                answer = sum(w in there for w in bench.answers[item]) / len(bench.answers[item])
                if not weak[item]:
                    share = common_subsequence(words, region) / len(words)
                elif len(words) < limits.short:
                    share = longest_run(words, verbatim) / len(words)
                else:
                    share = dense_subsequence(words, verbatim) / len(words)
                    if limits.likely <= share < limits.sure and longest_run(words, verbatim) < limits.short:
                        continue
                found = (share, answer, float(dots[r, c] / length[part + r]))
                if (d, item) not in best or found > best[d, item]:
                    best[d, item] = found
        for (d, item), (share, answer, cosine) in best.items():
            if len(bench.words[item]) < limits.short:
                good = share >= 1.0
            else:
                good = share >= limits.sure or (share >= limits.likely and answer >= limits.answered)
            if good:
                yield number + d, item, cosine, share, answer


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    limits: Limits = Limits(),
    items_at_once: int = 500,
    seed: int = 11,
) -> DataFrame:
    """doc_id, item_id, cosine, common (share), answer (share): a row for each document and item found."""
    spark = docs.sparkSession
    id_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {id_kind}, item_id {item_kind}, cosine double, common double, answer double"
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    blocks = max(1, math.ceil(rows.count() / items_at_once))
    out = None
    for k in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        bench = Benchmark.of(sorted(((r.item_id, r.text) for r in mine.collect()), key=lambda x: (x[0] is None, x)), limits.piece)
        if not bench.items:
            continue
        vocabulary = spark.sparkContext.broadcast(bench.vocabulary)
        ids = written(_ids_table(docs, vocabulary, ["doc_id"]), "bench-words")
        seen, total = _block_counts(ids, len(bench.vocabulary), limits.block)
        full, idf, weak_pieces, weak = weights(bench, seen, total, limits)
        vectors, sizes = bench.vectors(idf)
        width = min(limits.dimensions, *vectors.shape)
        mix = np.random.default_rng(seed).standard_normal((width, len(vectors))).astype(np.float32)
        start, _ = np.linalg.qr((mix @ vectors).T.astype(np.float64))
        basis = latent_basis(ids, start, idf, limits.block)
        pieces = vectors @ basis
        share = np.maximum(np.linalg.norm(pieces, axis=1), 1e-12)  # of each piece that the space holds
        pieces, sizes = pieces / share[:, None], sizes * share
        model = spark.sparkContext.broadcast((bench, full, idf, weak_pieces, weak, basis, pieces, sizes))

        def search(doc_ids: list, data: list) -> Iterator[tuple]:
            bench = model.value[0]
            for d, item, cosine, share, answer in _matches(data, *model.value, limits):
                yield doc_ids[d], bench.items[item], cosine, share, answer

        found = written(map_columns(ids, ["doc_id", "ids"], schema, search), "bench-found")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs whose text holds no passage of the benchmark.  Decided by text: rows without id, or with an id that others
    have, go or stay like any other."""
    if "__text" in docs.columns:
        raise ValueError("__text is a column already")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, limits).select(F.col("doc_id").alias("__text")).distinct()
    return docs.withColumn("__text", key).join(found, "__text", "left_anti").select(*docs.columns)
