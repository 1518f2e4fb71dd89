"""Labels, negation, conversations and retrieval by group against direct loops."""

import collections
import math
import random

from pyspark.sql import functions as F

from harborline.operators import matching as M
from harborline.operators import retrieval as V


def test_weak_labels_by_a_direct_loop(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "a-b", "c++", "!"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6))]) for i in range(300)]
    rows += [(-1, None, ["a"]), (-2, "a b", None), (-3, "a b", [None, ""]), (-4, "A a", ["a", "a"])]
    got = {r.i: r.l for r in spark.createDataFrame(rows, "i int, t string, s array<string>").select("i", M.weak_labels("t", "s").alias("l")).collect()}
    for i, text, skills in rows:
        tokens = M.TAGGED.findall(text or "")
        plain = [M.UNTAGGED.sub("", t.lower()) for t in tokens]
        labels = ["O"] * len(tokens)
        for skill in sorted({s for s in skills or [] if s}, key=lambda s: (-len(s), s)):
            wanted = [w for t in M.TAGGED.findall(skill) if (w := M.UNTAGGED.sub("", t.lower()))]
            for at in range(len(tokens) - len(wanted) + 1 if wanted else 0):
                if labels[at] == "O" and plain[at : at + len(wanted)] == wanted:
                    labels[at : at + len(wanted)] = ["B"] + ["I"] * (len(wanted) - 1)
        assert (got[i].labels, got[i].tokens) == ((labels, tokens) if "B" in labels else (None, None)), i


def test_negation_on_both_sides(spark):
    rows = ["kubernetes: not needed, kubernetes", "no kubernetes", "kubernetes and cloud, none of it", "not " + "-" * 15 + "cloud", "not " + "-" * 14 + "cloud", "Cloud not", "", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r[0] for r in df.select(M.without_negated(F.col("t"), ["kubernetes", "cloud"], ["not", "no "])).collect()]
    assert got == [": not needed, ", "no ", "kubernetes and cloud, none of it", "not " + "-" * 15 + "cloud", "not " + "-" * 14, "Cloud not", "", None]


def test_conversations(spark):
    rows = [(1, 0, "user", "x"), (1, 1, "user", "say MARK: a  b\n"), (1, 2, "assistant", " "), (2, 0, "assistant", "y"), (3, 0, "user", "t"), (3, 1, "user", None), (4, 0, "user", "u"), (4, 3, "assistant", " z ")]
    got = sorted(map(tuple, M.conversation_records(spark.createDataFrame(rows, "c int, n int, r string, t string"), "c", "n", "r", "t", "MARK:").collect()))
    assert got == [(1, "a b", None), (4, "u", "z")]


def test_bm25_by_group(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["g", "g", "h", None, "no query"]), [rng.choice("abcdefg") for _ in range(rng.randint(0, 9))]) for i in range(200)]
    docs += [(900 + i, "g", ["a", "b"]) for i in range(9)] + [(990, "g", None), (991, "g", [])]
    queries = [("g", ["a", "a", "zz"]), ("g", ["b"]), ("h", ["c"]), ("empty", ["a"]), (None, ["a"]), ("h", None)]
    left, right = spark.createDataFrame(docs, "d int, g string, w array<string>"), spark.createDataFrame(queries, "g string, q array<string>")
    got = sorted(tuple(r)[:3] for r in V.bm25_by_group(left, "g", "d", "w", right, "q", 8).select("g", "d", "score").collect())
    want = []
    for g in ("g", "h"):
        mine = [(d, w or []) for d, k, w in docs if k == g]
        sizes = [len(w) for d, k, w in docs if k == g and w is not None]
        mean, asked = sum(sizes) / len(sizes), collections.Counter(w for k, q in queries if k == g for w in q or [])
        scores = []
        for d, ws in mine:
            s = 0.0
            for w, times in asked.items():
                df, f = sum(w in x for _, x in mine), ws.count(w)
                s += times * math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ws) / mean)) if f else 0
            if s > 0:
                scores.append((-round(s, 5), d))
        want += [(g, d, -s) for s, d in sorted(scores)[:8]]
    assert got == sorted(want)
    blocks = V.bm25_by_group(left, "g", "d", "w", right, "q", 8, most_words=1)
    assert sorted(tuple(r)[:3] for r in blocks.select("g", "d", "score").collect()) == got
    assert V.bm25_by_group(left, "g", "d", "w", right.limit(0), "q", 8).count() == 0
    assert V.bm25_by_group(left.limit(0), "g", "d", "w", right, "q", 8).count() == 0
