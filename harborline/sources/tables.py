"""Reading and writing tables: by suffix, by column aliases, JSON lines, zipped news archives, partitioned indexes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.sources.jsonarrays import array_files, as_lines

#: Names that a posting's fields may have, first choice first.
POSTING_FIELDS = {
    "title": ("title", "job_title", "job_title_short", "position"),
    "description": ("description", "job_description", "description_text", "job_summary", "job_details"),
    "date": ("posted_date", "post_date", "listed_time", "original_listed_time", "job_posted_date", "date"),
    "salary": ("salary", "salary_yearly", "salary_mid", "pay", "max_salary", "min_salary"),
    "company": ("company", "company_name", "employer_name"),
    "url": ("job_url", "url", "apply_url", "job_link"),
    "arrangement": ("work_arrangement", "remote", "location_type", "job_is_remote"),
}


def read_any(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with header, Parquet or JSON lines by suffix; None for other suffixes."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl"):
        return read_records(spark, path)
    return None


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of JSON lines or of JSON arrays, on one line or many, told by each file's first character; lines
    and elements that do not parse are skipped."""
    files = array_files(spark, path)
    reader = spark.read.option("mode", "DROPMALFORMED")
    reader = reader.schema(schema) if schema else reader
    return reader.json(as_lines(spark, path, files) if any(files.values()) else path)


def posting_columns(df: DataFrame, fields: dict[str, tuple[str, ...]] = POSTING_FIELDS) -> dict[str, str] | None:
    """Field to column, case aside; None unless title, and description or date, and date, company or salary are there."""
    names = {c.lower(): c for c in df.columns}
    found = {f: names[a] for f, aliases in fields.items() if (a := next((x for x in aliases if x in names), None))}
    good = "title" in found and ("description" in found or "date" in found) and {"date", "company", "salary"} & found.keys()
    return found if good else None


def as_postings(df: DataFrame) -> DataFrame | None:
    found = posting_columns(df)
    return None if found is None else df.select(*[F.col(c).alias(f) for f, c in found.items()])


def conform(df: DataFrame, schema) -> DataFrame:
    """The schema's columns in its order; missing ones as typed nulls; others cast, bad values as null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def coalesced(*choices, otherwise: str | None = None) -> Column:
    """The first choice that is neither null nor blank."""
    told = [F.when(F.trim(c.cast("string")) != "", c) for c in choices]
    return F.coalesce(*told, F.lit(otherwise))


def union_of_sources(sources: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Rows of all sources under one set of fields, with the source's name; a field that a source does not map is null.

    sources: name -> (rows, field -> column).
    """
    out = None
    for name, (rows, fields) in sources.items():
        mine = rows.select(F.lit(name).alias("source"), *[c.alias(f) for f, c in fields.items()])
        out = mine if out is None else out.unionByName(mine, allowMissingColumns=True)
    return out


def read_zipped_news(spark: SparkSession, pattern: str, columns: list[str], most_files: int | None = None) -> DataFrame:
    """Rows of the archives that the pattern names, of the first most_files by path if that is given."""
    files = spark.read.format("binaryFile").load(pattern)
    if most_files is not None:
        files = files.orderBy("path").limit(most_files)
    return unzipped(files.select("content"), columns)


def unzipped(files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the first .csv in each archive (content), tab-separated UTF-8; one archive is one task's unit of work."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    name = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
                    if name is None:
                        continue
                    with archive.open(name) as lines:
                        for part in iter(lambda: list(_some(lines, 10_000)), []):
                            cells = [(line.decode("utf-8", "replace").rstrip("\r\n").split("\t") + [None] * len(columns))[: len(columns)] for line in part]
                            yield pd.DataFrame(cells, columns=columns)

    return files.select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))


def _some(lines, n: int) -> Iterator[bytes]:
    for _ in range(n):
        line = lines.readline()
        if not line:
            return
        yield line


def write_both(df: DataFrame, parquet: str, json: str) -> None:
    df.write.mode("overwrite").parquet(parquet)
    df.write.mode("overwrite").json(json)


def write_index(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write partitioned by keys, rows of a partition together, and return what was written.

    The rebalance hint lets Spark split large partitions, so one key's rows need not fit a task.
    """
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return df.sparkSession.read.parquet(path)


def manifest(index: DataFrame, key: str, month: str) -> DataFrame:
    return index.groupBy(key).agg(F.count("*").alias("rows"), F.sort_array(F.collect_set(F.col(month).cast("string"))).alias("months"))
