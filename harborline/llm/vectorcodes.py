"""Product-quantised vector codes with memoised grid cells.

Vectors become integers and are cut into parts of equal length; each part position has a codebook.  To assign a part,
its coarse grid cell is hashed: a cell's cache entry lists the codebook entries that are not dominated across the
cell's box, that is, whose least distance to the box is no more than the smallest of all greatest distances.  Only
those are evaluated exactly, so the nearest entry (ties to the lower index) is always found, as by a full search.

A round is one pass: tasks add up counts and component sums by part and entry, the sums are added in a shuffle of
parts * entries rows a task, and the codebooks (of fixed size) go back to the driver.

Left out: vectors that are null, hold null or non-finite components, or differ in length from that of the smallest
id.  Null ids come last; repeated rows count each.  No rows left: no result.  A length that the number of parts does not
divide, or integers of 2**28 and more, are an error.  Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import released, written

#: Labels whose sums are broadcast.
MOST_BROADCAST = 100_000
#: Cells that a task remembers for each part before it starts anew.
MOST_CELLS = 1 << 15
MOST_MAGNITUDE = 1 << 28


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def integers(df: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """id, label and v, the components as floor(scale * x), of the usable rows."""
    v = F.col(vector_column).cast("array<double>")
    return df.where(usable(v)).select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


class Cells:
    """The nearest codebook entries of parts, by way of their cells."""

    def __init__(self, books: np.ndarray, width: int, most: int = MOST_CELLS):
        self.books, self.width, self.most = books, width, most
        self.known: list[dict[bytes, np.ndarray]] = [{} for _ in books]

    def undominated(self, part: int, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries may be nearest to a point of its box."""
        low = cells[:, None, :] * self.width
        high, book = low + self.width - 1, self.books[part][None]
        least = np.maximum(np.maximum(low - book, book - high), 0)
        most = np.maximum(np.abs(book - low), np.abs(book - high))
        return (least * least).sum(2) <= (most * most).sum(2).min(1, keepdims=True)

    def candidates(self, part: int, cells: np.ndarray) -> list[np.ndarray]:
        known = self.known[part]
        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(range(len(names)))
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            for i, keep in zip(some, self.undominated(part, cells[some])):
                known[names[i]] = np.flatnonzero(keep)
        return [known[name] for name in names]

    def nearest(self, part: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry."""
        cells, which = np.unique(np.floor_divide(points, self.width), axis=0, return_inverse=True)
        lists = self.candidates(part, cells)
        longest = max(map(len, lists))
        padded = np.stack([np.pad(c, (0, longest - len(c)), mode="edge") for c in lists])[which.reshape(-1)]
        gap = points[:, None, :] - self.books[part][padded]
        away = (gap * gap).sum(2)
        best = away.argmin(1)  # candidates ascend, so the first is the lowest index
        rows = np.arange(len(points))
        return padded[rows, best], away[rows, best]

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) of indices, and of squared distances."""
        parts = vectors.reshape(len(vectors), len(self.books), -1)
        found = [self.nearest(p, parts[:, p]) for p in range(len(self.books))]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def vectors_of(batch: pa.RecordBatch, name: str = "v", step: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a batch's vectors, all of one length, with their first row."""
    for at in range(0, batch.num_rows, step):
        column = batch.column(name).slice(at, step)
        found = column.flatten().to_numpy().reshape(len(column), -1)
        if np.abs(found).max(initial=0) >= MOST_MAGNITUDE:
            raise ValueError(f"components must be below {MOST_MAGNITUDE}")
        yield at, found


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 64) -> np.ndarray | None:
    """Codebooks (parts, entries, length / parts) of rows (id, v); None if there are no rows.

    They start as the parts of the `entries` smallest ids; each round replaces an entry by the floor of the mean
    of the parts assigned to it; one that got none stays.
    """
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    length = len(first[0].v)
    if length % parts or not length:
        raise ValueError(f"vectors of length {length} do not have {parts} equal parts")
    first = [r.v for r in first if len(r.v) == length]
    books = np.array(first, np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    rows = rows.where(F.size("v") == length).select("v")
    sums = ", ".join(f"s{i} long" for i in range(books.shape[2]))
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def added(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            cells, total, count = Cells(books, width), np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for _, vectors in vectors_of(batch):
                    split = vectors.reshape(len(vectors), *books.shape[::2])
                    codes, _ = cells.codes(vectors)
                    for p in range(len(books)):
                        np.add.at(total[p], codes[:, p], split[:, p])
                        count[p] += np.bincount(codes[:, p], minlength=books.shape[1])
            p, e = np.nonzero(count)
            columns = [pa.array(p), pa.array(e), pa.array(count[p, e]), *(pa.array(c) for c in total[p, e].T)]
            yield pa.RecordBatch.from_arrays(columns, names=["p", "e", "n", *(f"s{i}" for i in range(books.shape[2]))])
            released()

        found = rows.mapInArrow(added, f"p long, e long, n long, {sums}").groupBy("p", "e")
        found = found.agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(books.shape[2])))
        books = books.copy()
        for r in found.collect():  # parts * entries rows at most
            books[r.p, r.e] = [r[f"s{i}"] // r.n for i in range(books.shape[2])]
    return books


def encode(rows: DataFrame, books: np.ndarray, width: int = 64) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distance) of rows (id, label, v) of the books' length."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    length = books.shape[0] * books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(shared.value, width)
        for batch in batches:
            for at, vectors in vectors_of(batch):
                codes, away = cells.codes(vectors)
                ids, labels = batch.column("id").slice(at, len(vectors)), batch.column("label").slice(at, len(vectors))
                texts = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)])
                yield pa.RecordBatch.from_arrays([ids, labels, texts, pa.array(away.sum(1))], names=["id", "label", "code", "error"])
        released()

    kinds = dict(rows.dtypes)
    return rows.where(F.size("v") == length).select("id", "label", "v").mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", name: str = "decoded") -> DataFrame:
    """Add the vector of integers that a code stands for."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    index = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(name, F.flatten(F.array(*[flat[p][index(p)] for p in range(len(books))])))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, comma-joined by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    width: int = 64,
) -> DataFrame:
    """id, code, error, label_error (the label's sum of errors; nulls are one label), codebooks_sha256."""
    rows = written(integers(df, id_column, vector_column, label_column, scale), "vectors")
    books = train(rows, parts, entries, rounds, width)
    if books is None:
        nothing = rows.select(F.col("id").alias(id_column), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return nothing.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(""))
    found = written(encode(rows, books, width), "codes")
    sums = written(found.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= MOST_BROADCAST
    joined = found.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
