"""JSON arrays of any size and layout, read by many tasks.

Spark's text source cuts files at each `{`, so pieces are short and a file is split like any other, whether its array
stands on one line or on many.  Where a split begins, it is not known how deep it stands and whether within a string.
One pass sums up every split for each of the three states it may begin in (outside, in a string, after a backslash
there): the state it ends in, the change of depth, and the least depth.  The sums of a file, one row a split, are
composed in order.  A second pass, with each split's true beginning, cuts out the elements; what an element has in
other splits is joined to it by the split where it began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.sources.scratch import scratch_path

OUTSIDE, STRING, ESCAPED = 0, 1, 2
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|["{}\[\]]', re.S)
REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, value): the text up to each `{`, in order within a split (path, start)."""
    rows = spark.read.option("lineSep", "{").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def array_files(spark: SparkSession, path: str) -> dict[str, bool]:
    """Whether each file begins with a bracket, blanks aside."""
    heads = pieces(spark, path).where("start = 0").withColumn("at", F.monotonically_increasing_id())
    first = heads.groupBy("path").agg(F.min_by("value", "at").alias("value"))
    return {r.path: r.array for r in first.select("path", F.col("value").rlike(r"^[\s\uFEFF]*\[").alias("array")).collect()}


def tail_state(text: str) -> int:
    """The state after a string that is still open: whether its last backslash waits for a character."""
    return ESCAPED if (len(text) - len(text.rstrip("\\"))) % 2 else STRING


def steps(text: str, state: int) -> Iterator[tuple[int, int, int]]:
    """(end, change of depth, state) of each bracket outside of strings; at last (length, 0, state at the end)."""
    at = 0
    if state == ESCAPED:
        at, state = min(1, len(text)), STRING if text else ESCAPED
    if state == STRING:
        m = REST_OF_STRING.match(text, at)
        if m is None:
            yield len(text), 0, tail_state(text[at:]) if len(text) > at else state
            return
        at = m.end()
    for m in TOKEN.finditer(text, at):
        found = m.group()
        if found == '"':  # opens, and does not close here
            yield len(text), 0, tail_state(text[m.end() :])
            return
        if len(found) == 1:
            yield m.end(), 1 if found in "{[" else -1, OUTSIDE
    yield len(text), 0, OUTSIDE


def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    """Each row's split and its text, with the `{` that the cut took."""
    key = None
    for frame in frames:
        for path, start, value in zip(frame["path"], frame["start"], frame["value"]):
            first = (path, start) != key
            key = (path, start)
            yield key, value if first and start == 0 else "{" + value


def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, start, ends, changes, leasts) of each split, by the state it begins in."""

    def row(key, now):
        return pd.DataFrame({"path": [key[0]], "start": [key[1]], "ends": [[x[0] for x in now]], "changes": [[x[1] for x in now]], "leasts": [[x[2] for x in now]]})

    key, now = None, []
    for here, text in in_order(frames):
        if here != key:
            if key is not None:
                yield row(key, now)
            key, now = here, [[s, 0, 0] for s in (OUTSIDE, STRING, ESCAPED)]
        done: dict[int, tuple[int, int, int]] = {}
        for x in now:
            if x[0] not in done:
                change = least = 0
                for _, d, end in steps(text, x[0]):
                    change += d
                    least = min(least, change)
                done[x[0]] = (end, change, least)
            end, change, least = done[x[0]]
            x[:] = end, x[1] + change, min(x[2], x[1] + least)
    if key is not None:
        yield row(key, now)


def beginnings(group: pd.DataFrame) -> pd.DataFrame:
    """(path, start, state, depth, owner): how each split of a file begins; owner: the split where its open element began."""
    group = group.sort_values("start")
    state, depth, owner, out = OUTSIDE, 0, -1, []
    for path, start, ends, changes, leasts in group[["path", "start", "ends", "changes", "leasts"]].itertuples(index=False):
        out.append((path, start, state, depth, owner if depth > 1 else -1))
        if depth <= 1 or depth + leasts[state] <= 1:
            owner = start
        depth, state = depth + changes[state], ends[state]
    return pd.DataFrame(out, columns=["path", "start", "state", "depth", "owner"])


def elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, owner, start, text): whole elements with owner -1, and the parts of those that go over a split's end.

    Elements that are no objects are left out.
    """
    begun: dict[tuple[str, int], tuple[int, int, int]] = {}

    def noted() -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, state, depth, owner in frame[["path", "start", "state", "depth", "owner"]].drop_duplicates().itertuples(index=False):
                begun[path, start] = state, depth, owner
            yield frame

    found: list[tuple] = []
    key, held, is_open, mine, depth, state = None, [], False, -1, 0, OUTSIDE

    def batch() -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["path", "owner", "start", "text"])
        found.clear()
        return out

    for here, text in in_order(noted()):
        if here != key:
            if is_open:
                found.append((key[0], mine, key[1], "".join(held)))
            key, held = here, []
            state, depth, mine = begun.pop(here)
            is_open = mine >= 0
        at = 0
        for end, change, state in steps(text, state):
            if change == 1 and depth == 1 and text[end - 1] == "{":
                held, is_open, mine, at = [], True, key[1], end - 1
            depth += change
            if change == -1 and depth == 1 and is_open:
                held.append(text[at:end])
                found.append((key[0], -1 if mine == key[1] else mine, key[1], "".join(held)))
                held, is_open = [], False
        if is_open:
            held.append(text[at:])
        if len(found) >= 4096:
            yield batch()
    if is_open:
        found.append((key[0], mine, key[1], "".join(held)))
    if found:
        yield batch()


def array_elements(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """(value): the objects of the arrays in the files, one on a line each; an element that its file cuts off is left out."""
    rows = pieces(spark, path)
    if files is not None:
        rows = rows.where(F.col("path").isin(files))
    summed = rows.mapInPandas(sums, "path string, start long, ends array<int>, changes array<long>, leasts array<long>")
    begun = summed.groupBy("path").applyInPandas(beginnings, "path string, start long, state int, depth long, owner long")
    begun = F.broadcast(begun)  # a row for each split, as the driver lists them
    cut = rows.join(begun, ["path", "start"]).mapInPandas(elements, "path string, owner long, start long, text string")
    whole = cut.where("owner < 0").select("text")
    parts = cut.where("owner >= 0").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("l"))
    parts = parts.where(F.col("l")[0]["start"] == F.col("owner"))  # else what began there is no object
    joined = parts.select(F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(joined).select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))


def as_lines(spark: SparkSession, path: str, files: dict[str, bool]) -> str:
    """A scratch folder with the records of all files, one on a line."""
    target = scratch_path(spark, "records")
    out = array_elements(spark, path, [f for f, array in files.items() if array])
    if not all(files.values()):
        plain = spark.read.text(path).where(F.col("_metadata.file_path").isin([f for f, array in files.items() if not array]))
        out = out.unionByName(plain.select("value"))
    out.write.text(target)
    return target
