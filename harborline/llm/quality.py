"""Quality classification by a sparse rule ensemble.

A random forest is grown over text statistics of a bounded labelled sample; every path from a root to a node
becomes a conjunctive rule; a lasso logistic regression picks and weighs few of the rules; the rules that
keep a weight are compiled into one Spark column expression over the statistics of every whole text.

The statistics are column expressions, so nothing leaves the JVM when a table is scored.  Null and empty
texts have all-zero statistics and are scored like any other; without labelled rows every score is 0.5.
Each row is scored alone: repeated rows get equal scores and rows without id are scored.  Other columns pass
through whatever their names; only a column named as the score itself is an error.  Of several labels of one
doc_id one counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import spread_sample, written

STATISTICS = ["length", "capitals", "signs", "digits", "breaks", "bars", "repeats", "distinct", "word_length", "marked"]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and a struct column `stats` of STATISTICS.

    Shares are per character or per word.  repeats: words equal to the word before; distinct: distinct words
    of all; marked: words that end in a doubled sign.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(F.col("__t"), F.lit(pattern)).cast("double")
    chars = F.greatest(F.col("__n"), F.lit(1)).cast("double")
    words = F.greatest(F.col("__words"), F.lit(1)).cast("double")
    cut = F.split(F.trim("__t"), r"\s+")
    stats = F.struct(
        F.log1p(F.col("__n").cast("double")).alias("length"),
        (count(r"\p{Lu}") / chars).alias("capitals"),
        (count(r"[#$%&*!^~=<>{}]") / chars).alias("signs"),
        (count(r"[0-9]") / chars).alias("digits"),
        (count(r"\n") / words).alias("breaks"),
        (count(r"\|") / words).alias("bars"),
        (count(r"(?<![^ \n])([^ \n]++)(?=[ \n]\1(?![^ \n]))") / words).alias("repeats"),
        (F.col("__distinct") / words).alias("distinct"),
        (F.col("__n") / words).alias("word_length"),
        (count(r"([#$%&*!?])\1") / words).alias("marked"),
    )
    counted = docs.withColumn("__t", t).withColumn("__cut", cut)
    counted = counted.withColumn("__n", F.length("__t")).withColumn("__words", F.size("__cut"))
    counted = counted.withColumn("__distinct", F.size(F.array_distinct("__cut")).cast("double"))
    return counted.withColumn("stats", stats).drop("__t", "__cut", "__n", "__words", "__distinct")


Condition = tuple[str, str, float]  # statistic, "<=" or ">", bound


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self, stats: str = "stats") -> Column:
        """The score as a column expression."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: tuple[Condition, ...], stats: str = "stats") -> Column:
    tests = [F.col(f"{stats}.{s}") <= F.lit(b) if op == "<=" else F.col(f"{stats}.{s}") > F.lit(b) for s, op, b in rule]
    return reduce(lambda a, b: a & b, tests)


def tree_rules(printed: str) -> list[tuple[Condition, ...]]:
    """The paths to all nodes below the roots of a printed forest, each once."""
    rules: dict[tuple[Condition, ...], None] = {}
    path: list[tuple[int, Condition]] = []
    for line in printed.splitlines():
        if not (m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line)):
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(m[2])], m[3], float(m[4])))]
        rules[tuple(dict.fromkeys(c for _, c in path))] = None
    return list(rules)


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    per_label: int = 4000,
    trees: int = 10,
    depth: int = 3,
    lasso: float = 0.002,
    seed: int = 7,
) -> RuleModel:
    """Fit on at most per_label rows of each label among those where usable (of doc_id) holds."""
    known = labels.where(usable & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("quality"))
    ids = spread_sample(known.dropDuplicates(["doc_id"]), per_label, "quality", "doc_id").drop("__order")
    sample = with_statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    sample = written(sample.select("doc_id", "quality", "stats").orderBy("doc_id").coalesce(2), "quality-sample")
    sizes = {r.quality: r["count"] for r in sample.groupBy("quality").count().collect()}
    if not sizes:
        return RuleModel(0.0, ())
    if len(sizes) == 1:
        return RuleModel(4.0 if 1.0 in sizes else -4.0, ())
    total, kinds = sum(sizes.values()), len(sizes)
    weight = reduce(lambda c, k: c.when(F.col("quality") == k, F.lit(total / (kinds * sizes[k]))), sizes, F.when(F.lit(False), 1.0))
    flat = sample.select("quality", weight.alias("weight"), "stats", *[F.col(f"stats.{s}").alias(s) for s in STATISTICS])
    shaped = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(flat).cache()
    forest = RandomForestClassifier(
        labelCol="quality", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="sqrt"
    ).fit(shaped)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel(0.0, ())
    marks = flat.select("quality", F.array(*[holds(r).cast("double") for r in rules]).alias("marks"))
    from pyspark.ml.functions import array_to_vector

    marks = marks.select("quality", array_to_vector("marks").alias("features")).coalesce(2).cache()
    line = LogisticRegression(labelCol="quality", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(marks)
    shaped.unpersist()
    marks.unpersist()
    kept = tuple((float(w), r) for w, r in zip(line.coefficients.toArray(), rules) if abs(w) > 1e-6)
    return RuleModel(float(line.intercept), kept)


def score(docs: DataFrame, model: RuleModel, name: str = "score", text: str = "text") -> DataFrame:
    """docs and the score of each row's text, as `name`."""
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    names = [f"__c{i}" for i in range(len(docs.columns))]  # so that no column clashes with the statistics
    found = with_statistics(docs.toDF(*names), names[docs.columns.index(text)])
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], model.column().alias(name))
