"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters), cut into words, and matched
against a lexicon in one Aho-Corasick pass; a match inside an exception phrase does not count.  The score is
a logistic function of the weight found per word, so that it does not grow with length alone.

Terms, their weights, the exception phrases and the logistic function are learned from a bounded sample:
at most per_label rows of each label.  A term is a word that far more toxic than clean rows hold, its weight
the logarithm of that ratio; an exception is a pair of words around a term that clean rows hold and toxic
rows do not.  A term stands in a hundredth of the toxic rows of the sample, so their number is bounded by it.

Null and empty texts score like a text without matches.  Each row is scored alone: repeated rows get equal
scores, rows without id are scored, and all other columns, whatever their names, pass through untouched; only
a column named as the score itself is an error.  Of several labels of one doc_id one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import map_columns, spread_sample, text_column, written

#: Letters of other scripts, digits and signs by the Latin letter they look like.
LOOKALIKES = {
    "a": "аαａ@4", "b": "вƄｂ8", "c": "сϲｃ", "d": "ԁｄ",
    "e": "еεｅ3", "g": "ɡｇ9", "h": "һｈ", "i": "іιıｉ1",
    "j": "јｊ", "k": "кκｋ", "l": "ӏｌ", "m": "мｍ", "n": "ոｎ",
    "o": "оοｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ",
    "s": "ѕｓ5$", "t": "тτｔ7", "u": "սｕ", "v": "νｖ", "w": "ԝｗ",
    "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
FOLD = str.maketrans({sign: letter for letter, signs in LOOKALIKES.items() for sign in signs})
UNSEEN = re.compile("[­​-‏⁠﻿]")
INNER_MARK = re.compile(r"(?<=\w)[!](?=\w)")
BETWEEN = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Words of the text after folding, each between single blanks."""
    text = (text or "").lower()
    if not text.isascii():
        text = UNSEEN.sub("", text)
    if "!" in text:
        text = INNER_MARK.sub("i", text)
    return f" {BETWEEN.sub(' ', text.translate(FOLD)).strip()} "


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    line: tuple[float, float, float]  # intercept, for any match, for weight per word

    def machine(self) -> ahocorasick.Automaton | None:
        """All terms and exceptions in one automaton."""
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(f" {term} ", (len(term) + 2, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def features(self, words: str, machine: ahocorasick.Automaton | None) -> tuple[float, float]:
        """Whether folded words hold a term; the logarithm of the weight in a hundred words."""
        if machine is None:
            return 0.0, 0.0
        hits: list[tuple[int, int, float]] = []
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in machine.iter(words):
            (spared if weight is None else hits).append((end - length + 1, end) if weight is None else (end - length + 1, end, weight))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
        total = sum(h[2] for h in hits)
        return float(total > 0), float(np.log1p(100.0 * total / max(1, words.count(" ") - 1)))

    def scores(self, texts: list, machine: ahocorasick.Automaton | None) -> list[float]:
        found = np.array([self.features(folded(t), machine) for t in texts]).reshape(-1, 2)
        return (1 / (1 + np.exp(-(self.line[0] + found @ np.array(self.line[1:]))))).tolist()


def _counted(sample: DataFrame, of: str, grams) -> DataFrame:
    """n_toxic, n_clean: rows of the sample that hold each of grams(words)."""

    def rows(texts: list, toxic: list) -> Iterator[tuple]:
        for text, label in zip(texts, toxic):
            for gram in grams(folded(text)):
                yield gram, int(label == 1), int(label != 1)

    each = map_columns(sample, ["text", "toxic"], f"{of} string, toxic int, clean int", rows)
    return each.groupBy(of).agg(F.sum("toxic").alias("n_toxic"), F.sum("clean").alias("n_clean"))


def fit_line(features: np.ndarray, label: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, over all sampled rows."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        w = w - np.linalg.solve(hess, grad)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = 8000) -> ToxicityModel:
    """Fit on at most per_label rows of each label among those where usable (of doc_id) holds."""
    known = labels.where(usable & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = written(spread_sample(known.dropDuplicates(["doc_id"]), per_label, "toxic", "doc_id").drop("__order"), "toxicity-ids")
    sizes = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not n_toxic:
        return ToxicityModel({}, (), (-3.0, 0.0, 0.0))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")
    sample = written(sample, "toxicity-sample")
    words = _counted(sample, "term", lambda w: set(w.split()))
    ratio = F.log(((F.col("n_toxic") + 0.1) / (n_toxic + 1)) / ((F.col("n_clean") + 0.1) / (n_clean + 1)))
    terms = (
        words.where(F.col("n_toxic") >= max(3, n_toxic // 100))
        .withColumn("weight", ratio)
        .where((F.col("weight") > 2.0) & (F.length("term") > 2))
        .collect()
    )
    weights = {r.term: float(r.weight) for r in sorted(terms, key=lambda r: r.term)}

    def around(words: str) -> set[str]:
        w = words.split()
        return {f"{a} {b}" for a, b in zip(w, w[1:]) if a in weights or b in weights}

    spared = (
        _counted(sample, "phrase", around)
        .where((F.col("n_toxic") == 0) & (F.col("n_clean") >= 3))
        .collect()
    )
    model = ToxicityModel(weights, tuple(sorted(r.phrase for r in spared)), (0.0, 0.0, 0.0))

    def rows(texts: list, toxic: list) -> Iterator[tuple]:
        machine = model.machine()
        for text, label in zip(texts, toxic):
            yield (*model.features(folded(text), machine), int(label == 1))

    found = map_columns(sample, ["text", "toxic"], "found double, density double, toxic int", rows)
    groups = found.groupBy("found", F.round("density", 3).alias("density"), "toxic").count().collect()
    data = np.array([[r.found, r.density, r.toxic, r["count"]] for r in groups], float)
    data = np.repeat(data[:, :3], data[:, 3].astype(int), axis=0)
    return ToxicityModel(weights, model.exceptions, fit_line(data[:, :2], data[:, 2]))


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """docs and the score of each row's text, as `name`."""
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    held: list = []  # a task's automaton

    def values(texts: list) -> list[float]:
        if not held:
            held.append(model.machine())
        return model.scores(texts, held[0])

    return docs.withColumn(name, text_column(F.col("text"), "double", values))
