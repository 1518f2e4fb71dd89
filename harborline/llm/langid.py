"""Language identification by string kernels.

Kernel: blended-spectrum presence.  A text is the set of byte n-grams (1 to `longest` bytes, hashed to
`buckets` cells) of its letters; K(x, z) = |x and z| / sqrt(|x| |z|).  Nystroem landmarks span the kernel's
feature space, one-versus-rest kernel ridge regression is fitted there, and whole texts are scored in
batches: presence matrix times landmarks, times coefficients.

The classifier is fitted on a bounded sample: at most per_language labelled rows of each language, fetched
from the whole table by hash order.  Null texts and texts without a letter are `und` with score 0, as is
everything when there is nothing to learn from.  Ties go to the language that sorts first.  Each row is
predicted alone, so repeated rows get equal results and rows without id are predicted; columns other than
doc_id, the text and those asked for are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import map_columns, spread_sample

#: Anything in ASCII but letters counts as a blank.
BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def presence(text: str, buckets_log2: int, longest: int) -> np.ndarray:
    """Boolean cells of the byte n-grams of the lower-cased text."""
    cells = np.zeros(1 << buckets_log2, bool)
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(BLANKS).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = np.zeros(len(b), np.uint32)
    shift = np.uint32(32 - buckets_log2)
    for n in range(1, longest + 1):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        mixed = code ^ (code >> np.uint32(15))
        cells[(mixed * np.uint32(2654435761)) >> shift] = True
    return cells


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x cells, float32, each divided by the root of its size
    coefficients: np.ndarray  # landmarks x languages
    buckets_log2: int
    longest: int

    def scores(self, cells: np.ndarray) -> np.ndarray:
        """One row for each text, one column for each language; cells: texts x cells, boolean."""
        norm = np.sqrt(np.maximum(cells.sum(1), 1)).astype(np.float32)
        return (cells.astype(np.float32) @ self.landmarks.T / norm[:, None]) @ self.coefficients


def fit(texts: list[str], languages: list[str], landmarks: int, ridge: float, buckets_log2: int, longest: int) -> LanguageModel:
    """Nystroem features of the sample, then ridge regression on +1/-1 for each language."""
    names = sorted(set(languages))
    cells = np.stack([presence(t, buckets_log2, longest) for t in texts])
    label = np.array([names.index(x) for x in languages])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(label == i)[:each] for i in range(len(names))])
    marks = cells[chosen].astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    kernel = np.concatenate(
        [(c := cells[i : i + 256].astype(np.float32)) @ marks.T / np.sqrt(np.maximum(c.sum(1, keepdims=True), 1)) for i in range(0, len(cells), 256)]
    ).astype(np.float64)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > values.max() * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    # each language weighs the same
    weight = 1.0 / np.bincount(label, minlength=len(names))[label]
    weight *= len(label) / weight.sum()
    gram = (features * weight[:, None]).T @ features + ridge * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, (features * weight[:, None]).T @ target)
    return LanguageModel(names, marks, (root @ solved).astype(np.float32), buckets_log2, longest)


def train(
    docs: DataFrame,
    usable: Column,
    per_language: int = 384,
    landmarks: int = 64,
    ridge: float = 1.0,
    buckets_log2: int = 13,
    longest: int = 4,
) -> LanguageModel | None:
    """Fit on per_language of the rows where usable holds and lang and text are set, all of a language with fewer.

    The rows come in the order of a hash of id and text; repeated rows count once.  The first of each language
    are its landmarks.  The sample is bounded by per_language rows for each language.
    """
    key = F.xxhash64("doc_id", "text")
    good = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("__key", key)
    keys = spread_sample(good.select("lang", "__key").distinct(), per_language, "lang", "__key")
    found = good.select("lang", "__key", "text").join(F.broadcast(keys), ["lang", "__key"]).dropDuplicates(["lang", "__key"])
    rows = sorted(found.select("lang", "__order", "text").collect())
    kept = [(r.lang, r.text) for r in rows if has_letter(r.text)]
    if not kept:
        return None
    return fit([t for _, t in kept], [x for x, _ in kept], landmarks, ridge, buckets_log2, longest)


def predict(docs: DataFrame, model: LanguageModel | None, extra: list[str] | None = None, at_once: int = 128) -> DataFrame:
    """doc_id, the extra columns, lang_pred, score (softmax of the best language) for each row."""
    extra = extra or []
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", *extra]) + ", lang_pred string, score double"

    def rows(ids: list, *columns: list) -> Iterator[tuple]:
        *others, texts = columns
        for i in range(0, len(texts), at_once):
            part = texts[i : i + at_once]
            good = [k for k, t in enumerate(part) if model is not None and has_letter(t)]
            found: dict[int, tuple[str, float]] = {}
            if good:
                scores = model.scores(np.stack([presence(part[k], model.buckets_log2, model.longest) for k in good]))
                sharp = np.exp(4.0 * (scores - scores.max(1, keepdims=True)).astype(np.float64))
                best = scores.argmax(1)
                for k, b, s in zip(good, best, sharp / sharp.sum(1, keepdims=True)):
                    found[k] = (model.languages[b], float(s[b]))
            for k in range(len(part)):
                yield (ids[i + k], *(o[i + k] for o in others), *found.get(k, ("und", 0.0)))

    return map_columns(docs, ["doc_id", *extra, "text"], schema, rows)
