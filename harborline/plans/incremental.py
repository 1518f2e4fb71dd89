"""Sources, sinks and streams over the given tables."""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.plans.registry import Registry
from harborline.sources import tables as T
from harborline.sources.scratch import scratch_path
from harborline.streaming import incremental as I

R = Registry()

#: Batches of a stream over files that are all there, at most: each batch opens and saves the whole state, so
#: batches that grew in number with the files would make the work grow with their square.
MOST_BATCHES = 4


def _named(name: str, sql: str | None):
    def keep(run):
        R.queries[name] = run
        if sql is not None:
            R.oracle[name] = sql
        return run

    return keep


def _archives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("readme.txt", "news")
            archive.writestr("news.csv", "\n".join(frame["line"]) + "\n")
        yield pd.DataFrame({"content": [out.getvalue()]})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as files that come in no order of time, two to a batch, or more if that would be over MOST_BATCHES."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "arrivals")
    count = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(count, "event_id").write.parquet(path)
    return I.files(spark, path, "*.parquet", rows.schema, max(2, math.ceil(count / MOST_BATCHES)))


def _lateness(spark: SparkSession, sf_dir: str) -> str:
    """As long as the events span, 40 days at least: the files come in no order of time, so any event may come last."""
    days = F.datediff(F.max("ts"), F.min("ts")) + 1
    return f"{spark.read.parquet(f'{sf_dir}/events.parquet').agg(F.greatest(F.lit(40), days)).first()[0]} days"


@_named("a02_postings_by_alias", "SELECT o_orderpriority AS title, o_orderstatus AS description, o_totalprice AS salary FROM orders")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two names for a title the first in the list is taken."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    named = o.select(F.lit("other").alias("job_title"), F.col("o_orderpriority").alias("Title"), F.col("o_orderstatus").alias("JOB_SUMMARY"), F.col("o_totalprice").alias("pay"), "o_custkey")
    return T.as_postings(named)


@_named("a01_a03_a07_round_trip", "SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS city FROM customer")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    path = scratch_path(spark, "customers")
    T.write_both(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal"), f"{path}.parquet", f"{path}.json")
    return T.conform(T.read_any(spark, f"{path}.json"), _parse_datatype_string("c_custkey long, c_name string, c_acctbal double, city string"))


def _array_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of one JSON array: some elements on one line, some on many."""
    before = "["
    for frame in frames:
        lines = []
        for i, record in enumerate(frame["r"]):
            lines += [before, *(record if i % 3 else record.replace(",", " ,\n\t").replace("{", "{\n", 1)).split("\n")]
            before = ","
        yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": [before, "]"] if before == "[" else ["]"]})


@_named("a03_json_arrays", "SELECT c_custkey, c_name, c_acctbal, [c_mktsegment, '}{\"'] AS marks FROM customer")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as files that hold one JSON array each, over many lines, with brackets and quotes in strings."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", F.array("c_mktsegment", F.lit('}{"')).alias("marks"))
    path = scratch_path(spark, "arrays")
    c.select(F.to_json(F.struct("*")).alias("r")).mapInPandas(_array_lines, "value string").write.text(path)
    return T.read_records(spark, path, "c_custkey long, c_name string, c_acctbal double, marks array<string>")


@_named("a08_partitioned_index", """SELECT 'events' AS kind, o_orderpriority AS role, count(*) AS rows, list_sort(list(DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'))) AS months FROM orders GROUP BY 2
    UNION ALL SELECT 'jobs', p_type, count(*), list_sort(list(DISTINCT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d'))) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 2""")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by role and month, postings by role, and the manifest of both."""
    o, l, p = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "part"))
    events = o.select(F.col("o_orderpriority").alias("role"), F.trunc("o_orderdate", "month").alias("month"), "o_orderkey", "o_totalprice")
    jobs = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("role"), F.trunc("l_shipdate", "month").alias("month"), "l_orderkey", "l_extendedprice")
    path = scratch_path(spark, "index")
    return T.manifest(T.write_index(events, f"{path}/events", ["role", "month"]), "role", "month").select(F.lit("events").alias("kind"), "*").unionByName(
        T.manifest(T.write_index(jobs, f"{path}/jobs", ["role"]), "role", "month").select(F.lit("jobs").alias("kind"), "*")
    )


@_named("t01_running_aggregate", """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "running")
    rows = I.running_aggregate(_events(spark, sf_dir), "ts", _lateness(spark, sf_dir), "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")], f"{path}/out", f"{path}/state")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_named("t02_upserted", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "upserted")
    stream = _events(spark, sf_dir).select("user_id", "event_type", "event_id")
    return I.upserted(stream, ["user_id"], "event_id", f"{path}/out", f"{path}/state")


@_named("t03_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "deduplicated")
    stream = _events(spark, sf_dir).select("user_id", "event_type", "ts")
    return I.deduplicated(stream, ["user_id", "event_type"], "ts", _lateness(spark, sf_dir), f"{path}/out", f"{path}/state").select("user_id", "event_type")


@_named("a04_zipped_news", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events zipped, a batch to an archive, and read again."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("\t", "event_id", "event_type", "user_id").alias("line"))
    news = T.unzipped(rows.mapInPandas(_archives, "content binary"), ["id", "event_type", "user_id"])
    return news.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("user_id").cast("long")).alias("users"))
