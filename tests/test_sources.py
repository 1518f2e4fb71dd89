"""JSON arrays and lines in every layout, cut at every place."""

import json
import random

import pytest

from harborline.sources import jsonarrays as J
from harborline.sources import tables as T

SCHEMA = "i long, s string, n struct<a: array<long>, b: string>"


def some_records(n, seed=1):
    rng = random.Random(seed)
    texts = ["", 'q"uote', "br{ace}", "[x]", "back\\slash", "\\", '\\"', "é😀", "new\nline", "{", "}", "tail\\\\", ", "]
    return [{"i": i, "s": rng.choice(texts), "n": {"a": [1] * rng.randint(0, 3), "b": rng.choice(texts)} if rng.random() < 0.7 else None} for i in range(n)]


def records(rows):
    return sorted((r.i, r.s, None if r.n is None else (tuple(r.n.a), r.n.b)) for r in rows)


def wanted(items):
    return sorted((x["i"], x["s"], x["n"] and (tuple(x["n"]["a"]), x["n"]["b"])) for x in items)


@pytest.fixture
def cut_small(spark):
    """Splits of a few bytes, so that strings, escapes and elements go over their ends."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [61, 400, 100_000])
def test_layouts_agree(spark, tmp_path, cut_small, size):
    items = some_records(20)
    layouts = {
        "one": json.dumps(items), "pretty": json.dumps(items, indent=3), "wide": "\n\n  " + json.dumps(items, indent="\t").replace("\n", "\r\n"),
        "raw": json.dumps(items, ensure_ascii=False, separators=(",", ":")), "lines": "\n".join(map(json.dumps, items)),
    }
    cut_small(size)
    for name, text in layouts.items():
        (tmp_path / f"{name}.json").write_text(text)
        assert records(T.read_any(spark, str(tmp_path / f"{name}.json")).select("i", "s", "n").collect()) == wanted(items), name
    assert T.read_records(spark, str(tmp_path), SCHEMA).count() == 5 * len(items)  # a folder of both kinds


@pytest.mark.parametrize("size", [61, 100_000])
def test_broken_arrays_agree(spark, tmp_path, cut_small, size):
    items = some_records(30, 3)
    cut_small(size)
    for name, indent in (("one", None), ("pretty", 2)):
        parts = [json.dumps(x, indent=indent) for x in items]
        parts[4] = '{"i": 4, "s": , "n": null}'
        parts[9] = '"a {scalar} [string]"'
        parts[12] = "[17, {\"i\": 99}]"
        text = "[" + ",\n".join(parts)  # and no end
        text = text[: text.rindex("}")]
        (tmp_path / f"{name}.json").write_text(text)
        got = records(T.read_records(spark, str(tmp_path / f"{name}.json"), SCHEMA).collect())
        assert got == wanted([x for x in items if x["i"] not in (4, 9, 12, 29)]), name


def test_empty_and_bad_files(spark, tmp_path):
    for i, text in enumerate(["", "[]", " [ \n ]", "[1, 2]", "not json\n{\"i\": 1}\n\n{bad\n"]):
        (tmp_path / f"{i}.json").write_text(text)
        assert T.read_records(spark, str(tmp_path / f"{i}.json"), SCHEMA).count() == (1 if i == 4 else 0), text


def test_steps_from_any_place():
    """The sums of any cut of a text give the state and depth of the whole."""
    text = '[{"a\\\\": "{\\"[", "b": [1, {"c": "}"}]}, "x\\\\\\"]"]'
    for cut in range(len(text)):
        state, depth = J.OUTSIDE, 0
        for part in (text[:cut], text[cut:]):
            for _, change, state in J.steps(part, state):
                depth += change
        assert (state, depth) == (J.OUTSIDE, 0), cut
