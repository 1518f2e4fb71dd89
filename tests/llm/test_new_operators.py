"""Operators 11 to 13 against brute force, with awkward rows throughout: nulls in any column, empty and long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import htmltext, merkle, sharding, vectorcodes
from harborline.llm.common import table

FOLDER = "/root/testdata/sf0.001"

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, node string, tree string, pos long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def steps_of(nodes, arity=16):
    """The root of a list of nodes, and each node's (before, after) in every run above it."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_under = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for j in range(len(run)):
                for i in under[at + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            up_under.append([i for u in under[at : at + arity] for i in u])
        nodes, under = up, up_under
    return nodes[0], paths


def manifest_of(rows, arity=16):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((mine, *steps_of([leaf_of(r) for r in mine], arity)))
    root, over = steps_of([t[1] for t in trees], arity)
    out = []
    for (mine, subroot, paths), rest in zip(trees, over):
        for r, path in zip(mine, paths):
            path = path + rest
            node = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                node = leaf_of((*r[:4], lower))
            for before, after in path:
                node = H(before, node, after)
            out.append((r[0], leaf_of(r), subroot, root, H(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def some_documents(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "Été ÀB cd", "x" * 100_000 + "Q", "\n\t\x00", "ABC", "abc"]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.5 else rng.choice([None, "", "é", "Z", "a", "z" * 40, f"s{rng.randint(0, 30)}"])
        rows.append((i if rng.random() < 0.97 else None, source, rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice(texts), "x", "y", "z", 1))
    return rows + rows[:9]


@pytest.mark.parametrize("n, arity, levels", [(1, 16, 2), (17, 16, 2), (700, 16, 1), (900, 3, 2), (200, 2, 1)])
def test_manifest_is_that_of_one_list(spark, n, arity, levels):
    rows = some_documents(n, n)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    altered = {"text": F.when(hit, merkle.lower_cased(F.col("text"))).otherwise(F.col("text"))}
    found = merkle.manifest(docs, altered=altered, arity=arity, levels=levels)
    assert sorted(map(tuple, found.collect()), key=repr) == manifest_of(rows, arity)


def test_manifest_witness_and_empty_table(spark):
    docs = spark.createDataFrame(some_documents(60, 5), DOCS)
    for r in merkle.manifest(docs, with_witness=True).collect():
        assert r.verified and merkle.folded(r.leaf, [tuple(s) for s in r.witness]) == r.root
    assert merkle.document_manifest(docs.limit(0)).count() == 0
    assert merkle.document_manifest(docs.limit(0)).columns == merkle.document_manifest(docs).columns


VECTORS = "vec_id long, embedding array<float>, label string, code string, id string, v long, error int"


def codes_of(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    ints = {id(r): [int(np.floor(scale * float(np.float32(x)))) for x in r[1]] for r in kept}
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, ints[id(r)]))
    size = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == size * parts]
    cut = [[ints[id(r)][p * size : (p + 1) * size] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        who = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        new = []
        for p in range(parts):
            new.append([])
            for i, old in enumerate(books[p]):
                mine = [c[p] for c, w in zip(cut, who) if w[p] == i]
                new[p].append([sum(x) // len(mine) for x in zip(*mine)] if mine else old)
        books = new
    last = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in x) for x in last]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in x), e, labels[r[2]], sha) for r, x, e in zip(kept, last, errors)), key=repr)


def some_vectors(n, seed, size=32):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.1, 0.25]) if i % 3 else rng.gauss(0, 0.4) for _ in range(size)], rng.choice([None, "a", "a", "b"]), "x", "y", 1, 2) for i in range(n)]
    awkward = [None, [], [None] * size, [float("nan")] * size, [float("inf")] * size, [0.5] * (size * 2)]
    return rows[5:] + [(i + n, v, "a", "x", "y", 1, 2) for i, v in enumerate(awkward)] + rows[:20] + [(None, [0.3] * size, None, "x", "y", 1, 2)]


@pytest.mark.parametrize("n, entries, width", [(300, 64, 64), (40, 64, 16), (150, 8, 1), (60, 64, 1 << 20)])
def test_vector_codes_are_those_of_a_full_search(spark, n, entries, width):
    rows = some_vectors(n, n)
    found = vectorcodes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries, width=width)
    assert sorted(map(tuple, found.collect()), key=repr) == codes_of(rows, entries=entries)


def test_cells_that_are_forgotten_and_decoding(spark):
    rng = np.random.default_rng(1)
    books, points = rng.integers(-90, 90, (1, 64, 4)), rng.integers(-200, 200, (3000, 4))
    away = ((points[:, None, :] - books[0][None]) ** 2).sum(2)
    for most in (1, 50, 1 << 15):
        cells = vectorcodes.Cells(books, 32, most)
        for at in range(0, 3000, 500):
            found, gap = cells.nearest(0, points[at : at + 500])
            assert (found == away[at : at + 500].argmin(1)).all() and (gap == away[at : at + 500].min(1)).all()
    rows = vectorcodes.integers(spark.createDataFrame(some_vectors(80, 2), VECTORS), "vec_id", "embedding", "label", 256)
    trained = vectorcodes.train(rows)
    coded = vectorcodes.encode(rows, trained).join(rows.select("id", "v").dropDuplicates(), "id")
    for r in vectorcodes.decode(coded, trained).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.v, r.decoded)) == r.error


def test_vector_codes_without_rows(spark):
    nothing = vectorcodes.vector_codes(spark.createDataFrame([], VECTORS))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vectorcodes.vector_codes(spark.createDataFrame([(1, [0.1] * 17, "a", "x", "y", 1, 2)], VECTORS))


def test_blocks_of_broken_pages():
    page = """<!DOCTYPE html><html><head><title>no &amp; no</title><style>p{}</style><script>var t="</p>";</script></head><body>
        <!-- <p>no</p> --><div class="Side-Bar"><a href="/x">one</a> two<ul><li>a<li>b &lt;c&gt;</ul></div>
        <p>p &am; q<br>r<b>s<p>1 < 2 &amp 3<table><tr><td>x<td>y</table><h1>h</h1>tail<textarea>no</textarea>
        <p title="a>b">quoted</p></i></div><span>end</span></body></html><p>after<a"""
    found = htmltext.blocks(page)
    assert [b.text for b in found] == ["one two", "a", "b <c>", "p &am; q rs", "1 < 2 & 3", "x", "y", "h", "tail", "quoted", "end", "after"]
    assert found[0].linked == 3 and htmltext.words_of(found[0].path[2][1]) == ("side", "bar")
    assert [[t for t, _ in b.path] for b in found[1:3]] == [["html", "body", "div", "ul", "li"]] * 2
    assert htmltext.blocks("") == htmltext.blocks("<p> \xa0</p><!-- x") == htmltext.blocks("<script>x") == htmltext.blocks("<p <p <p") == []
    assert [b.text for b in htmltext.blocks("a" * 300_000 + "<" * 50 + "<p>" * 20_000 + "b")] == ["a" * 300_000 + "<" * 50, "b"]


def test_chain_by_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 7):
        score, kinds, steps = rng.normal(0, 2, n), rng.integers(0, 2, n), rng.normal(0, 1, (2, 2, 2))
        of = lambda y: sum(score[i] * y[i] for i in range(n)) + sum(steps[kinds[i], y[i - 1], y[i]] for i in range(1, n))
        every = list(itertools.product((0, 1), repeat=n))
        assert tuple(htmltext.best_labels(score.tolist(), kinds[1:].tolist(), steps.tolist())) == max(every, key=of)
        mass = np.exp([of(y) for y in every])
        share = [sum(m for m, y in zip(mass, every) if y[i]) / mass.sum() for i in range(n)]
        padded = [np.stack([np.pad(x, (0, 3)), np.pad(x, (0, 3))]) for x in (score, kinds, np.ones(n, bool))]
        got, pairs = htmltext.marginals(padded[0], steps, padded[1], padded[2])
        assert np.allclose(got[:, :n], share)
        for i in range(n - 1):
            want = sum(m for m, y in zip(mass, every) if y[i] and not y[i + 1]) / mass.sum()
            assert np.allclose(pairs[:, i, 1, 0], want)


def article_of(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", inner)]
    return "\n".join(p for p in parts if p)


def test_main_text_of_pages(spark):
    pages = table(spark, FOLDER, "pages")
    for r in htmltext.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text == article_of(r.html) and r.n_chars == len(r.text)


def test_main_text_of_other_layouts(spark):
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").collect()]
    model = htmltext.fit(htmltext.labelled(pages[:150]))
    extractor = htmltext.Extractor(model)
    held, wrong, total = htmltext.labelled(pages[150:], 2, seed=5), 0, 0
    for found, labels in held:
        steps = [htmltext.joined(a, b) for a, b in zip(found, found[1:])]
        got = htmltext.best_labels([extractor.scored(b) for b in found], steps, extractor.steps)
        wrong, total = wrong + sum(a != b for a, b in zip(got, labels)), total + len(labels)
    assert total > 1500 and wrong / total < 0.02
    page = """<body><header><h2>Site name</h2></header><div class="cookie-consent">We use cookies. <button>OK</button></div>
        <div id="navigation"><a href="/a">Home</a> <a href="/b">News</a></div>
        <main><h1>The river rises</h1><p>The river rose by two metres, and it is still rising.</p><div class="advert">Buy now.</div>
        <p>Nobody was hurt, the town said.</p><form><label>Mail</label><input><button>Sign up</button></form></main>
        <section id="comments"><p>What a day it was, said one reader.</p></section><footer>&copy; 2020 Site</footer></body>"""
    want = "The river rises\nThe river rose by two metres, and it is still rising.\nNobody was hurt, the town said."
    assert extractor.main_text(page) == want
    assert extractor.main_text(None) == extractor.main_text("") == extractor.main_text("<nav><a>x</a></nav>") == ""


def test_main_text_of_awkward_tables(spark):
    pages = table(spark, FOLDER, "pages")
    schema = "page_id long, url string, html string, text string, n_chars long, __html string"
    some = [r.html for r in pages.limit(30).collect()]
    rows = [(i, None, p, "x", 1, "y") for i, p in enumerate([None, "", "<p>", *some, some[0]])] + [(None, "u", some[0], "x", 1, "y")]
    got = {r.page_id: r.text for r in htmltext.main_texts(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i] for i in range(3)] == ["", "", ""] and got[3] == got[len(some) + 3] == got[None] == article_of(some[0])
    assert htmltext.main_texts(pages.limit(0)).count() == 0
    assert htmltext.main_texts(spark.createDataFrame([(1, "u", "<p>no article here</p>")], "page_id long, url string, html string")).first().text == ""


def test_labels_have_one_rank_at_every_size(spark):
    names = [None, *(f"label {i * 7919 % 301}" for i in range(301)), "label 5"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, lang string").repartition(6)
    order = {n: k for k, n in enumerate(sorted({n for n in names if n}))}
    want = {i: 0 if n is None else int(order[n] * (255 / 300)) for i, n in enumerate(names)}
    for few in (0, 65_536):
        found = sharding.with_rank(rows, "lang", "cell", 8, few)
        assert {r.i: r.cell for r in found.collect()} == want and found.columns == ["i", "lang", "cell"]
    assert [r.cell for r in sharding.with_rank(rows.where("i = 1"), "lang", "cell", 8).collect()] == [0]
    assert sharding.with_rank(rows.limit(0), "lang", "cell", 8).count() == 0
