"""Streams over files that are all there take few batches, however many the files are."""

import pytest
from pyspark.sql import functions as F

from harborline.plans import incremental

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["t02_upserted", "t03_deduplicated"])
def test_batches_do_not_grow_with_the_files(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(incremental, "scratch_path", lambda spark, what: str(tmp_path / what))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = incremental.R.queries[name](spark, FOLDER).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert rows == events.select("user_id", *["event_type"][: name != "t02_upserted"]).distinct().count()
    assert len(list(tmp_path.glob("arrivals/*.parquet"))) == 24
    assert len(list(tmp_path.glob(f"{name[4:]}/out/batch=*"))) in (4, 5)  # Spark adds one without rows where the last moved the watermark


def test_running_aggregate_does_not_take_more_batches_for_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "scratch_path", lambda spark, what: str(tmp_path / what))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = {(r.start, r.event_type): r.n for r in incremental.R.queries["t01_running_aggregate"](spark, FOLDER).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    days = spark.read.parquet(f"{FOLDER}/events.parquet").groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert rows == {(r.start.replace(tzinfo=None), r.event_type): r.n for r in days.collect()}
    assert len(list(tmp_path.glob("running/out/batch=*"))) in (4, 5)


def test_no_event_is_late_however_long_the_events_span(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    shifted = events.crossJoin(spark.range(4).toDF("k")).withColumn("ts", F.expr("ts + make_dt_interval(30 * int(k))")).drop("k")
    shifted.write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")  # four batches: Spark drops late rows from the third on
    try:
        rows = {(r.start, r.event_type): r.n for r in incremental.R.queries["t01_running_aggregate"](spark, str(tmp_path)).collect()}
        once = incremental.R.queries["t03_deduplicated"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    days = shifted.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert rows == {(r.start.replace(tzinfo=None), r.event_type): r.n for r in days.collect()}
    assert len(once) == len(set(once)) == events.select("user_id", "event_type").distinct().count()
