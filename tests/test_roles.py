"""Role matching: the inverted index by brute force, and the cases that decide a posting's role."""

import random
import re

from pyspark.sql import functions as F

from harborline.operators import matching as M
from harborline.operators import roles as X

SKILLED = "role string, aliases array<string>, skills array<string>, generic boolean"


def stands(term, text):
    return re.search(r"(?<![a-z0-9])" + re.escape(term.strip().lower()) + r"(?![a-z0-9])", text.lower()) is not None


def test_contained_terms_by_brute_force(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("ab1 .+#-\n") for _ in range(n))
    texts = [some(rng.randint(0, 30)) for _ in range(250)] + [None, "", "C++ and .NET, node.js", "x\x01a\x02b", "a" * 50_000]
    terms = [some(rng.randint(1, 5)) for _ in range(120)] + ["", "  ", "+", "c++", ".net", "js", "node.js", "A"]
    left = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    right = spark.createDataFrame([(t,) for t in terms + [None]], "term string")
    kept = {t for t in terms if t.strip(" ")}
    for bounded, holds in ((True, stands), (False, lambda term, text: term.strip(" ").lower() in text.lower())):
        got = sorted(map(tuple, M.contained_terms(left, "i", "t", right, "term", bounded).collect()))
        clean = lambda x: x.replace("\x01", " ").replace("\x02", " ") if bounded else x
        want = sorted((i, t) for i, x in enumerate(texts) if x is not None for t in kept if (re.search(r"(?<![a-z0-9])" + re.escape(t.strip(" ").lower()) + r"(?![a-z0-9])", clean(x).lower()) if bounded else t.strip(" ").lower() in x.lower()))
        assert got == want
    assert M.contained_terms(left, "i", "t", right.limit(0), "term").count() == 0
    plan = M.contained_terms(left, "i", "t", right, "term")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_skill_hits(spark):
    df = spark.createDataFrame([("Need C++, machine  learning and R; go now.", ["C++", "machine learning", "R", "Go", " now ", "", None, "spark"])], "t string, s array<string>")
    got = df.select(M.skill_hits(F.col("t"), F.col("s"), ["go"]).alias("h")).first().h
    assert got.hits == ["C++", "now"] and got.share == 0.5  # of c++, machine learning, now, spark


def best(spark, taxonomy, postings, **how):
    roles = spark.createDataFrame(taxonomy, SKILLED)
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(postings)], "id int, title string, body string, month string")
    scored = X.scored_roles(rows, "id", "title", "body", roles, "role", "aliases", "skills", "generic", **how)
    return {r.id: (r.role, r.score, r.by) for r in X.matched_postings(rows, "id", "month", scored, "role").collect()}


def test_best_role_of_postings(spark):
    taxonomy = [
        ("AI Agent Engineer", ["agentic ai engineer"], ["AI Agent", "LangChain", "RAG", "Python"], False),
        ("RAG Engineer", ["generative ai engineer"], ["RAG", "Vector Database", "LangChain", "Embedding"], False),
        ("Backend Java Engineer", [], ["Java", "Spring", "REST API", "Microservices", "AWS"], False),
        ("Delivery Manager", [], ["Agile", "Jira", "Confluence", "Scrum", "Kanban"], True),
        ("Node.js Developer", ["platform"], [f"k{i}" for i in range(10)] + ["terraform"], False),
    ]
    postings = [
        ("Generative AI Engineer", "RAG, LangChain and embedding work", "2026-06"),
        ("Senior Software Engineer", "Need Java, Spring and AWS experience.", "2026-06"),
        ("Agile Coach", "Agile, Jira, Confluence, Scrum, Kanban.", "2026-06"),
        ("Senior node.js engineer", None, "2026-06"),
        ("js engineer", "terraform", "2026-06"),
        ("platform lead", "terraform", "2026-06"),
        ("platform lead", "terraform", None),
        (None, None, "2026-06"),
        ("Delivery Manager", "parcels", "2026-06"),
        ("Java Spring expert", "microservices", "2026-06"),
    ]
    got = best(spark, taxonomy, postings)
    assert got == {
        0: ("RAG Engineer", 1.2, "mixed"),
        3: ("Node.js Developer", 0.65, "title"),
        5: ("Node.js Developer", 0.92, "alias"),  # terraform is the eleventh skill
        9: ("Backend Java Engineer", round(0.2 + 0.58 * 0.6 + 0.08, 6), "skill"),
    }
    assert best(spark, taxonomy, [("Delivery Manager", "software parcels", "m")], support=["software"])[0] == ("Delivery Manager", 1.0, "title")


def test_candidates_by_words_of_aliases_and_without_a_match(spark):
    roles = spark.createDataFrame([("a b", ["crimson cog"], [], False), ("qq", None, [], False)], SKILLED)
    rows = spark.createDataFrame([(1, "crimson hat"), (2, "zzz"), (3, None), (4, "xa by")], "id int, title string")
    got = sorted(map(tuple, X.role_candidates(rows, "id", "title", roles, "role", "aliases").collect()))
    assert got == [(1, "a b"), (2, "a b"), (2, "qq"), (3, "a b"), (3, "qq"), (4, "a b")]
    assert X.role_candidates(rows.limit(0), "id", "title", roles, "role", "aliases").count() == 0
    assert X.role_candidates(rows, "id", "title", roles.limit(0), "role", "aliases").count() == 0
