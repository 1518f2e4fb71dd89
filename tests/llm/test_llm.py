"""The numbered operators against brute force, round trips and held-out labels, with awkward rows throughout:
nulls in any column, empty and long texts, repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from harborline.llm import bpe, components, decontaminate, langid, pii, quality, repeats, sharding, simhash, topk, toxicity
from harborline.llm.common import id_fold, spread_sample, table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, base string, stats string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, FOLDER, "documents")


def test_language_held_out(spark, documents):
    out = id_fold("doc_id", 3) == 1
    model = langid.train(documents, ~out)
    got = langid.predict(documents.where(out), model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9
    odd = langid.predict(docs_of(spark, [None, "", "12 34 !", "The end of the day " * 9000]), model).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[3].lang_pred == "en"
    assert langid.train(documents.limit(0), F.lit(True)) is None
    assert langid.predict(documents.limit(2), None).first().lang_pred == "und"
    assert langid.predict(documents.limit(0), model).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_spans(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789.. --+()a@bé😀%") for _ in range(rng.randint(0, 120))) for _ in range(800)]
    texts += ["1.2.3.4." * 300, "300.1.2.3.4.5.6.7", "4111 1111 1111 1111 " * 200, "a@b.c" * 200, "a" * 20000 + "@", "1" * 20000, None, "", "x\na@b.co"]
    docs = docs_of(spark, texts)
    for r in pii.span_digests(docs).collect():
        expected = base_spans(texts[r.doc_id] or "")
        assert hashlib.sha256(expected.encode()).hexdigest() == r.base_sha256
        assert r.spans.startswith(expected)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[len(texts) - 1].text == "x\n[EMAIL]" and rows[0].base == "y"
    assert pii.span_digests(docs.limit(0)).count() == 0


def test_disclosing_terms(spark):
    texts = [f"word{i} filler Zorblatt ann.0@x.example more filler text, far away Zorblatt" for i in range(12)] + ["filler text of others"] * 3 + [f"other {i} filler" for i in range(200)]
    found = {r.doc_id: r.spans for r in pii.span_digests(docs_of(spark, texts)).collect()}
    at, far = texts[0].index("Zorblatt"), texts[0].rindex("Zorblatt")
    assert f"term:{at}:{at + 8}" in found[0] and f"term:{far}:{far + 8}" in found[0] and "term" not in found[len(texts) - 1]
    clean = pii.sanitised(docs_of(spark, texts))
    assert clean.where("doc_id = 0").first().text.count("[TERM]") >= 2 and clean.where("doc_id = 12").first().text == texts[12]


def brute_disclosing(texts, support, threshold):
    """Terms that disclose a kind, from whole texts."""
    patterns = PATTERNS | {"secret": r"(?<=token = \")[0-9a-f]{12,}"}
    texts = list(dict.fromkeys(texts))
    rows = []
    for t in texts:
        kinds = {k for k in PATTERNS if k in base_spans(t)} | ({"secret"} if re.search(patterns["secret"], t) else set())
        values = [xxhash.xxh64_intdigest(m.group().lower()) for p in patterns.values() for m in re.finditer(p, t)]
        masked = t
        for p in patterns.values():
            masked = re.sub(p, " ", masked)
        rows.append((kinds, min(values, default=0), set(re.findall(r"[^\W\d_]{3,}", masked.lower())), set(re.findall(r"[^\W\d_]+", t.lower()))))
    pairs = set()
    for kind in patterns:
        mine = [r for r in rows if kind in r[0]]
        for term in set().union(*(r[2] for r in mine), set()):
            both = [r for r in mine if term in r[2]]
            if len(both) < support or len({r[1] for r in both}) < 2 or len(mine) == len(texts):
                continue
            with_term = max(len(both), sum(term in r[3] for r in rows))
            n = len(texts)
            if np.log(n * len(both) / (with_term * len(mine))) / np.log(n / len(mine)) >= threshold - 1e-12:
                pairs.add((kind, term))
    return pairs


def test_disclosure_of_kinds_by_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [a + b for a in ("bra", "cul", "dex", "fam", "gor") for b in "abcdefghijklmnop"]
    value = {
        "email": lambda: f"{rng.choice(vocabulary)}.{rng.randint(10, 99)}@mail.example", "ip": lambda: ".".join(str(rng.randint(1, 250)) for _ in range(4)),
        "phone": lambda: f"+1 (217) 555-{rng.randint(1000, 9999)}", "secret": lambda: f'token = "{rng.getrandbits(80):020x}"',
    }
    hint = {"email": "write", "ip": "host", "phone": "call"}
    texts = []
    for i in range(400):
        words = rng.choices(vocabulary, k=30)
        if i % 5 == 0:
            kind = rng.choice(list(value))
            words += ([hint[kind]] if kind in hint and rng.random() < 0.9 else []) + rng.choices(vocabulary, k=12) + [value[kind]()]
        elif i % 40 == 1:
            words += ["host"]
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + [texts[5] + " x"] + [texts[5] + " y"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in pii.with_spans(docs, ["doc_id", "score"]).collect()}
    pairs = brute_disclosing(texts, 3, 0.9)
    assert {("secret", "token"), ("email", "write"), ("phone", "call")} <= pairs and ("ip", "host") not in pairs
    for i, t in enumerate(texts):
        kinds = {s["kind"] for s in got[i].base} | {s["kind"] for s in got[i].secrets}
        terms = {s["value"].lower() for s in got[i].terms}
        assert {w for k, w in pairs if k in kinds and re.search(rf"(?<![^\W\d_]){w}(?![^\W\d_])", t.lower())} <= terms
        assert got[i].score == "x" and (kinds or not terms)
        # the rest comes from values and groups, whose terms stand within the window
        assert terms <= {w for k, w in pairs} | {w for w in vocabulary}
    assert pii.with_spans(docs.limit(0), ["doc_id"]).count() == 0


def test_toxicity(spark, documents):
    rows = [(i, f"plain words here number {i} and more", 0) for i in range(60)] + [(100 + i, f"you idiot{' scum' * (i % 2)} number {i}", 1) for i in range(30)]
    rows += [(200 + i, f"idiot savant number {i}", 0) for i in range(4)]
    docs = docs_of(spark, []).limit(0)
    docs = spark.createDataFrame([(i, t, None, None, None, "s", "b", "t") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, None, x) for i, _, x in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    machine = model.machine()
    score = lambda t: model.scores([t], machine)[0]
    assert score("what an 1d10t he is") > 0.3 and score("what an іdіоt he is") > 0.3
    assert score("a fine day") < 0.3 and score(None) == score("") and "idiot savant" in model.exceptions
    out = toxicity.score(docs, model, "__toxicity")
    assert out.columns == [*docs.columns, "__toxicity"] and out.first().score == "s"
    by_id = {r.doc_id: r["__toxicity"] for r in out.collect()}
    assert len(by_id) == len(rows) and by_id[0] == score(rows[0][1]) and by_id[100] == score(rows[60][1]) > 0.3
    with pytest.raises(ValueError):
        toxicity.score(docs, model)
    odd = docs_of(spark, [None, "", "fine words " * 40_000, "idiot"]).drop("score")
    got = [r.score for r in toxicity.score(odd.unionByName(odd), model).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[2] == got[3] and got[4] == got[5] < 0.3 < got[6] == got[7]
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels.limit(0), F.lit(True)).weights == {}


@pytest.mark.parametrize("block,cells,fan", [(8192, 1 << 22, 16), (4, 64, 2)])
def test_exact_top_k(spark, block, cells, fan):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(40, [1.0] * 8), (40, [1.0] * 8), (500, None), (501, [float("nan")] * 8), (502, [None] * 8), (503, [1.0] * 7)]
    rows += [(600 + i, [1.0 + (i % 3)] * 8) for i in range(40)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x")).repartition(5)
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=7, query_block=block, cells=cells, fan=fan).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    usable = {(i, tuple(np.floor(64 * np.array(v)).astype(int))) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    for q in (0, 20, 40, 100, 600, 620):
        mine = [v for i, v in usable if i == q]
        scores = sorted(((int(np.dot(m, v)), i) for m in mine for i, v in usable if i != q and len(v) == len(m)), key=lambda x: (-x[0], x[1]))[:7]
        assert got[q] == scores
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.exact_top_k(df, F.lit(False)).count() == 0


def test_products_stay_exact_beyond_doubles():
    a = np.array([[(1 << 31) + 1, 3]], np.int64)
    b = np.array([[(1 << 30) + 7, -5], [1, 1]], np.int64)
    assert topk.products(a, b).tolist() == [[((1 << 31) + 1) * ((1 << 30) + 7) - 15, (1 << 31) + 4]]


def reach(fps):
    names = sorted(fps)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {n: find(n) for n in names}


def test_golay_keys_meet_at_three_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 64, 400, np.uint64)
    for bits in (1, 2, 3):
        other = fps.copy()
        for i in range(len(fps)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        keys = [collections.defaultdict(set), collections.defaultdict(set)]
        for side, values in zip(keys, (fps, other)):
            for k, p in zip(*simhash.golay_keys(values)):
                side[p].add(k)
        assert all(keys[0][i] & keys[1][i] for i in range(len(fps)))


@pytest.mark.parametrize("crowd", [256, 3])
def test_links_keep_components(spark, crowd):
    rng = np.random.default_rng(2)
    fps = {0: 0}
    for i in range(1, 250):
        value = fps[int(rng.integers(0, i))] if rng.random() < 0.8 else int(rng.integers(0, 1 << 63))
        for b in rng.choice(63, int(rng.integers(1, 5)), replace=False):
            value ^= 1 << int(b)
        fps[i] = value
    one = {}
    for i, v in fps.items():
        one.setdefault(v, i)
    nodes = spark.createDataFrame([(v,) for v in one], "fp long")
    links = simhash.links(nodes, 3, crowd)
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    got = {r.node: r.component for r in components.components(edges).collect()}
    expected = reach({v: v for v in one})
    groups = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert groups({v: got.get(v, v) for v in one}) == groups(expected)


def test_simhash_rows(spark):
    texts = ["one two three four", "ONE  two\tthree four", "one", None, "", "x y z " * 5000, "x y z " * 5000]
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    h = xxhash.xxh64_intdigest(b"one", 42)
    assert rows[2].fingerprint == f"{h:016x}" and rows[3].fingerprint == "0" * 16
    assert rows[1].component_id == 0 and rows[4].component_id == 3 and rows[6].component_id == 5
    kept = simhash.representatives(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5] and kept.columns == docs_of(spark, []).columns
    twice = docs_of(spark, texts).unionByName(docs_of(spark, texts))
    assert simhash.representatives(twice).count() == 4
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_components_by_fingerprint_not_by_id(spark, monkeypatch):
    """Rows without id link others, ids that have two texts do not; of all rows, by brute force."""
    known = {"zero": 0, "near": 7, "far": 63, "odd": 1, "other": 0x5555555555555555, "lone": -1}

    def prints(docs, words):
        value = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v).cast("long"))])
        return docs.select("doc_id", value[F.col("text")].alias("fp"))

    monkeypatch.setattr(simhash, "fingerprints", prints)
    rows = [(1, "zero"), (None, "near"), (2, "far"), (5, "other"), (5, "odd"), (9, "other"), (None, "lone"), (1, "zero")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in rows], SCHEMA)
    fps = [known[t] & (1 << 64) - 1 for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    want = [(i, f"{fp:016x}", min((k for (k, _), g in zip(rows, group) if g == mine and k is not None), default=None)) for (i, _), fp, mine in zip(rows, fps, group)]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == sorted(want, key=repr)


def test_near_copies_against_all_pairs(spark):
    """Orders of the same words share the word lanes' fingerprints; only some are copies of each other."""
    rng = random.Random(4)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"][:60]
    texts = []
    for _ in range(12):
        one = rng.sample(words, len(words))
        two = [*one[:30], one[31], one[30], *one[32:]]  # 50 of 62 shingles in common
        far = [*two[:15], two[16], two[15], *two[17:]]  # 0.81 to the second, under 0.8 to the first
        texts += [" ".join(one), " ".join(far), " ".join(two)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if x == old else x for x in parent]
    assert len(set(parent)) == 12
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == parent
    blocks = spark.createDataFrame([(i, 0) for i in range(len(texts))], "node long, component long")
    links = simhash.alike_in_blocks(docs_of(spark, texts).selectExpr("doc_id AS node", "text"), blocks, 0.8, tile=5)
    tiled = {r.node: r.component for r in components.components(links).collect()}
    assert [tiled.get(i, i) for i in range(len(texts))] == parent


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_around_leaders(spark, seed):
    """One block of many close copies, copies of copies at all distances, and strangers, by all pairs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(120)]
    texts = [list(base)]
    for i in range(150):
        t = list(base if i < 100 else rng.choice(texts))
        for _ in range(rng.choice([1, 1, 1, 2, 3, 4])):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    texts = [" ".join(t) for t in texts] + [" ".join(word() for _ in range(60)) for _ in range(9)]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if simhash.similarity(sets[i], sets[j]) >= 0.8]
    blocks = spark.createDataFrame([(i, 0) for i in range(len(texts))], "node long, component long")
    rows = docs_of(spark, texts).selectExpr("doc_id AS node", "text")
    group = lambda rows: {r.node: r.component for r in rows.collect()}
    expected = group(components.components(spark.createDataFrame(edges, "u long, v long")))
    assert 5 < len(set(expected.get(i, i) for i in range(len(texts)))) < len(texts) // 2
    for tile in (12, 40, 512):
        links = simhash.alike_in_blocks(rows, blocks, 0.8, tile=tile)
        assert group(components.components(links)) == expected
        assert all(simhash.similarity(sets[r.u], sets[r.v]) >= 0.8 - 1e-9 for r in links.collect())


def test_similarity_is_exact():
    one = np.arange(1000, dtype=np.uint64)
    sets = [one, one[:800], one[:799], one[:0], one[:0]]
    assert sorted(simhash.alike_forest(sets, 0.8)) == [(0, 1), (1, 2), (3, 4)]
    assert simhash.alike_forest([one, one[:799]], 0.8) == []
    assert simhash.alike_forest([one[:k] for k in range(0, 40)] + [one[:0]], 1.0) == [(0, 40)]


def test_quality(spark, documents):
    labels = table(spark, FOLDER, "labels")
    model = quality.train(documents, labels, F.lit(True))
    got = quality.score(documents, model).join(labels, "doc_id").select("score", "quality").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) > 0.9
    odd = docs_of(spark, [None, "", "a" * 100000, "\n\n"])
    with pytest.raises(ValueError):
        quality.score(odd, model)
    scored = quality.score(odd.unionByName(odd), model, "good")
    rows = scored.orderBy("doc_id").collect()
    assert scored.columns == [*odd.columns, "good"] and all(0 <= r.good <= 1 for r in rows) and rows[0].stats == "z" and rows[0].score == "x"
    assert rows[0].good == rows[1].good == rows[2].good and rows[4].good == rows[5].good
    assert quality.train(documents.limit(0), labels, F.lit(True)).rules == ()


def test_classifiers_held_out(spark):
    """Accuracy on rows that the models have not seen."""
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = id_fold("doc_id", 3) == 1
    got = quality.score(docs.where(out).select("doc_id", "text"), quality.train(docs, labels, ~out)).join(labels, "doc_id").where("quality IS NOT NULL").collect()
    assert len(got) > 80 and sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) > 0.95
    out = id_fold("doc_id", 4) == 2
    got = toxicity.score(docs.where(out).select("doc_id", "text"), toxicity.train(docs, labels, ~out)).join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    caught = [r.score >= 0.3 for r in got if r.toxic == 1]
    left = [r.score < 0.3 for r in got if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.6 and sum(left) / len(left) > 0.97


def test_sample_is_whole_where_a_class_is_small(spark):
    rows = [(i, "many") for i in range(3000)] + [(i, "few") for i in range(3000, 3040)]
    got = spread_sample(spark.createDataFrame(rows, "doc_id long, kind string"), 64, "kind", "doc_id").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"many": 64, "few": 40}


def test_rules_are_those_of_the_trees():
    printed = """Tree 0 (weight 1.0):
    If (feature 1 <= 0.5)
     If (feature 0 > 2.0)
      Predict: 0.0
     Else (feature 0 <= 2.0)
      Predict: 1.0
    Else (feature 1 > 0.5)
     Predict: 1.0
"""
    a, b = quality.STATISTICS[0], quality.STATISTICS[1]
    low, high = (b, "<=", 0.5), (b, ">", 0.5)
    assert set(quality.tree_rules(printed)) == {(low,), (low, (a, ">", 2.0)), (low, (a, "<=", 2.0)), (high,)}


def test_shards_prune_and_carry_sizes(spark, tmp_path):
    import zlib

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    placed = sharding.document_shards(docs).cache()
    rows = {r.doc_id: r for r in placed.collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(rows[i].size == len(t) + 16 and rows[i].text_crc32 == zlib.crc32(t) for i, t in texts.items())
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count()

    def read(column, low, high, frame):
        """Share of the shards whose range of the column meets the predicate."""
        ends = frame.groupBy("shard").agg(F.min(column).alias("a"), F.max(column).alias("b")).collect()
        return sum(r.a <= high and r.b >= low for r in ends) / len(ends)

    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(40)))
    for column, low, high in (("doc_id", 100, 150), ("lang", "fr", "fr"), ("source", "src3", "src3"), ("n_chars", 9000, 10**9)):
        assert read(column, low, high, back) < 0.75 * read(column, low, high, dealt), column
    ties = docs_of(spark, ["x"] * 50).withColumn("lang", F.lit("a")).withColumn("curve", F.lit("y"))
    assert sharding.document_shards(ties, 7).count() == 50


def test_hilbert_neighbours_and_shards(spark):
    cells = spark.range(512).selectExpr("id % 8 AS a", "(id div 8) % 8 AS b", "id div 64 AS c")
    walk = sorted((r.h, r.a, r.b, r.c) for r in cells.withColumn("h", sharding.hilbert_index([F.col(x) for x in "abc"], 3)).collect())
    assert [w[0] for w in walk] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:])) == 1 for a, b in zip(walk, walk[1:]))
    docs = docs_of(spark, ["same"] * 70 + [None, "", "long " * 5000] + [f"t{i}" for i in range(30)])
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for law in ("rows", "bytes"):
        rows = sharding.document_shards(docs, 7, law).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert len(rows) == docs.count() and all(sorted(s) == list(range(len(s))) for s in by.values())
        if law == "rows":
            assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.document_shards(docs.limit(0), 7).count() == 0


def test_bpe_agrees_and_returns(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.parse_ranks(open(path, "rb").read().splitlines())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in documents.limit(60).collect()] + [None, "", "a" * 20000, "ab" * 9000, " " * 3000 + "x", "é👩‍👩‍👧 \n\n  y<|endoftext|>"]
    rows = {r.doc_id: r for r in bpe.encode_decode(docs_of(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == theirs.encode_ordinary(t or "")
        assert bytes(rows[i].decoded).decode() == (t or "")
    assert bpe.encode_decode(docs_of(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_contamination(spark, documents):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    near = [word() if i % 9 == 4 else w for i, w in enumerate(item)]
    noise = lambda n: [word() for _ in range(n)]
    texts = [" ".join(noise(300)) for _ in range(40)]
    texts[3] = " ".join(noise(70) + item + noise(90))
    texts[4] = " ".join(noise(33) + near + noise(10))
    texts[5] = " ".join(noise(33) + item[:10] + noise(50))
    texts += [None, "", " ".join(item)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, " ... "), (7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(3, 7), (4, 7), (len(texts) - 1, 7)}
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == 0
    a, b = [1, 2, 3, 4, 5], [2, 9, 4, 5, 1]
    assert decontaminate.common_subsequence(a, b) == 3


def test_contamination_of_paraphrases_by_all_alignments(spark):
    """Every document in which some stretch aligns with an item to the sure share is found, and none under the likely one."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    items = [[word() for _ in range(rng.randint(20, 60))] for _ in range(12)]
    texts = []
    for n in range(120):
        item = list(items[n % 12])
        for _ in range(int(len(item) * rng.choice([0.0, 0.1, 0.2, 0.3, 0.6]))):
            k = rng.randrange(len(item))
            if rng.random() < 0.3:
                item.insert(k, word())
            else:
                item[k] = word()
        texts.append(" ".join([word() for _ in range(rng.randint(0, 120))] + item + [word() for _ in range(rng.randint(0, 120))]))
    texts += [" ".join(word() for _ in range(200)) for _ in range(60)]
    bench = [(i if i else None, " ".join(w), "x") for i, w in enumerate(items)]
    bench = spark.createDataFrame(bench + bench[:3], "item_id long, text string, cosine string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, texts).withColumn("common", F.lit(1)), bench).collect()]
    assert len(got) == len(set(got))
    limits = decontaminate.Limits()
    for d, text in enumerate(texts):
        words = text.split()
        for i, item in enumerate(items):
            share = decontaminate.common_subsequence(item, words) / len(item)
            assert share < limits.sure or (d, i or None) in got, (d, i, share)
            assert share >= limits.likely or (d, i or None) not in got, (d, i, share)
    kept = decontaminate.clean(docs_of(spark, texts).withColumn("doc_id", F.lit(None).cast("long")), bench)
    assert kept.count() == len(texts) - len({d for d, _ in got}) and kept.columns == docs_of(spark, []).columns


def test_singular_basis_spans_the_leading_space():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 8)) @ rng.normal(size=(8, 50)) + 1e-4 * rng.normal(size=(300, 50))
    start, _ = np.linalg.qr(rng.normal(size=(50, 12)))
    u = decontaminate.singular_basis(a.T @ (a @ start), start).astype(float)
    assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-4)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    assert np.linalg.norm(right[:8] @ u) ** 2 > 7.99
    assert np.allclose(np.linalg.norm(a @ u[:, :8], axis=0), values[:8], rtol=2e-2)


def test_contamination_of_common_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    noise = lambda n: " ".join(word() for _ in range(n))
    item, other, brief = noise(40), " ".join(rng.sample("of the to and in a is it for on as at by an or".split() * 3, 40)), "is it the"
    bench = spark.createDataFrame([(7, item), (8, other), (9, brief), (10, "absent words of a benchmark")], "item_id long, text string")
    filler = lambda: " ".join(rng.choice("of the to and in a is it for on as at by an or".split()) if rng.random() < 0.5 else word() for _ in range(300))
    # a third of the rows are copies of one leaked passage; another leaks item 8, whose words are all common
    texts = [filler().replace("is it the", "is the") for _ in range(60)]
    copied = f"{noise(50)} {item} {noise(60)}"
    texts += [copied] * 30 + [f"{noise(45)} {item} {noise(80)}", f"{noise(45)} {other} {noise(80)}", f"{noise(45)} {brief} {noise(80)}"]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert {d for d, i in got if i == 7} == set(range(60, 91))
    assert {d for d, i in got if i == 8} == {91}
    assert {d for d, i in got if i == 9} == {d for d, t in enumerate(texts) if " is it the " in t} >= {92}
    # a table of two documents, both leaked
    small = [f"{noise(20)} {item} {noise(20)}", f"{item} {noise(30)}"]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, small), bench).collect()}
    assert got == {(0, 7), (1, 7)}


def brute_removed(texts, length, window, words):
    blobs = [(t or "").encode() for t in texts]
    seen = {n: collections.Counter(b[a : a + n] for b in blobs for a in range(len(b) - n + 1)) for n in {length}}
    runs = lambda gone: sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if seen[length][b[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        told, spans = bytearray(gone), [m.span() for m in repeats.WORD.finditer(b)]
        for i in range(len(spans)):
            at, end = spans[i][0] - 1, i + words - 1
            while end < len(spans) and spans[end][1] + 1 - at < window:
                end += 1
            if at < 0 or end >= len(spans) or spans[end][1] == len(b):
                continue
            string = b[at : spans[end][1] + 1]
            if sum(len(re.findall(b"(?=" + re.escape(string) + b")", x)) for x in blobs if string in x) > 1:
                told[at + 1 : spans[end][1]] = b"\1" * (spans[end][1] - at - 1)
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((len(b), sum(gone), runs(gone), kept, runs(told), sum(told)))
    return out


@pytest.mark.parametrize("length,window,core,words,crowd", [(40, 20, 8, 5, 2000), (40, 20, 8, 5, 2), (17, 17, 9, 2, 3), (60, 15, 5, 6, 2000), (60, 15, 5, 6, 1)])
def test_repeats(spark, length, window, core, words, crowd):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé  \n") for _ in range(400)) for _ in range(6)]
    texts = []
    for _ in range(60):
        s = ""
        for _ in range(rng.randint(0, 6)):
            x = rng.randint(0, 300)
            s += rng.choice(base)[x : rng.randint(x, 400)] if rng.random() < 0.7 else "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 50)))
        texts.append(s)
    texts += ["a" * 900, "ab" * 300, None, "", texts[3], "q" * 40]
    docs = docs_of(spark, texts)
    rows = {r.doc_id: r for r in repeats.without_repeats(docs, length, window, core, words, crowd).collect()}
    for i, expected in enumerate(brute_removed(texts, length, window, words)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_passages, r.n_passage_bytes) == expected
    assert repeats.without_repeats(docs.limit(0), length, window, core, words, crowd).count() == 0


def test_repeats_of_rows_and_long_texts(spark):
    """Rows repeated with and without id, a text of several chunks, columns named as those worked with."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(54))
    assert len(passage) < 400
    long = " ".join(word() for _ in range(200_000))
    assert len(long) > 2 * repeats.CHUNK
    texts = [f"{word()} {passage} {word()}", f"{long} {passage} {long[:500]}", "short text", "lone " * 3]
    docs = docs_of(spark, texts).withColumn("h", F.lit(1)).withColumn("ranges", F.lit("x"))
    none = docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long"))
    got = repeats.without_repeats(docs.unionByName(none).unionByName(none)).collect()
    rows = {r.doc_id: r for r in got}
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 2
    assert rows[0].n_removed == 0 and rows[0].n_passages == 1 and rows[0].n_passage_bytes == len(passage)
    assert rows[1].n_removed == 1000 and rows[1].n_spans == 2 and rows[1].n_passages == 3 and rows[2].n_passages == 0
    same = spark.createDataFrame([(None, "y" * 900)] * 3 + [(7, "y" * 900)] * 2, "doc_id long, text string")
    assert {(r.n_removed, r.n_spans) for r in repeats.without_repeats(same).collect()} == {(900, 1)}


def test_near_copies_meet_by_all_pairs_of_a_table(spark):
    """Recall of pairs of 0.8 and more over all pairs of real rows; no group holds a row without a partner."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {}
    for r in docs.orderBy("doc_id").collect():
        texts.setdefault(r.text or "", r.doc_id)
    sets = {d: np.unique(simhash.shingle_hashes(t, 5)) for t, d in texts.items()}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for h in s.tolist():
            holders[h].append(d)
    near = {(a, b) for ds in holders.values() if 1 < len(ds) < 200 for i, b in enumerate(ds) for a in ds[:i]}
    pairs = {p for p in near if simhash.similarity(sets[p[0]], sets[p[1]]) >= 0.8}
    assert pairs
    group = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    met = sum(group[a] == group[b] for a, b in pairs)
    assert met / len(pairs) >= 0.95, (met, len(pairs))
    partnered = {d for p in pairs for d in p}
    assert {d for d in sets if sum(group[e] == group[d] for e in sets) > 1} <= partnered
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert kept == set(group.values())


def test_representatives_of_rows_that_share_ids(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (5, base + " end"), (5, "something else altogether here"), (7, "lone text of its own here"), (7, "lone text of its own here"), (None, base), (None, None)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(0, base), (1, base), (5, rows[2][1]), (7, rows[3][1])]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, FOLDER, "documents").withColumn("score", F.lit(1)).cache()
    columns, labels, benchmark = docs.columns, table(spark, FOLDER, "labels"), table(spark, FOLDER, "benchmark")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER).cache()
        before, kept = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, ids(after)
        if name != "tokens":
            assert after.columns == columns
        # every stage against its rule, row by row
        if name == "toxicity":
            model = toxicity.train(docs, labels, F.lit(True))
            machine = model.machine()
            assert kept == {d for d, t in before.items() if model.scores([t], machine)[0] < 0.3}
            toxic = {r.doc_id for r in labels.where("toxic = 1").collect()} & set(before)
            assert len(toxic & kept) <= 0.5 * len(toxic)  # few labels to learn from
        elif name == "near_duplicates":
            sets = {d: np.unique(simhash.shingle_hashes(t, 5)) for d, t in before.items()}
            edges = [(a, b) for a in sets for b in sets if a < b and simhash.similarity(sets[a], sets[b]) >= 0.8]
            parent = {d: d for d in sets}
            for a, b in edges:
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = {d: new if p == old else p for d, p in parent.items()} if old != new else parent
            assert kept == set(parent.values())
        elif name == "decontamination":
            found = ids(decontaminate.contaminated(docs.select("doc_id", "text"), benchmark))
            items = [decontaminate.words_of(r.text) for r in benchmark.collect()]
            aligned = {d for d, t in before.items() for i in items if len(i) >= 8 and decontaminate.common_subsequence(i, decontaminate.words_of(t)) >= 0.95 * len(i) and b" ".join(i) in b" ".join(decontaminate.words_of(t))}
            assert kept == set(before) - found and not aligned & kept
        elif name == "personal_data":
            assert kept == set(before)
            for r in after.collect():
                assert not base_spans(r.text or "") and ((before[r.doc_id] == r.text) or "[" in r.text)
        else:
            assert kept == set(before)
            for r in after.collect():
                assert r.decoded_sha256 == hashlib.sha256((before[r.doc_id] or "").encode()).hexdigest()
        assert 0 < len(kept)
        docs = after
