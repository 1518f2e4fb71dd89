"""Stream forms of incremental steps: running aggregates, micro-batch upserts, de-duplication.

Each runs to the end of what is there (availableNow) and leaves a table; state and output are in folders the
caller names, so a restarted run goes on where it stopped.  Output rows carry their batch, and a replayed
batch replaces itself, so a retry adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def files(spark, folder: str, name: str, schema, at_once: int = 100) -> DataFrame:
    """Files of the folder that match the name, at most at_once to a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", at_once).parquet(folder)


def _batches(stream: DataFrame, mode: str, out: str, state: str) -> DataFrame:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def running_aggregate(stream: DataFrame, at: str, late: str, width: str, keys: list[str], aggregates: list[Column], out: str, state: str) -> DataFrame:
    """Aggregates per key and window; each batch gives the windows it changed, the newest batch counts."""
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(*aggregates)
    flat = grouped.select(F.col("w.start").alias("start"), *[c for c in grouped.columns if c != "w"])
    rows = _batches(flat, "update", out, state)
    values = [c for c in rows.columns if c not in ("start", "batch", *keys)]
    newest = rows.groupBy("start", *keys).agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return newest.select("start", *keys, "r.*")


def upserted(stream: DataFrame, keys: list[str], order: str, out: str, state: str) -> DataFrame:
    """The row with the greatest order of each key: a batch keeps its best row, then the batches are merged."""

    def best(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in keys and c != "batch"]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")

    def write(batch: DataFrame, number: int) -> None:
        best(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return best(stream.sparkSession.read.parquet(out))


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str, out: str, state: str) -> DataFrame:
    """First row of each key within the watermark; state older than that is dropped."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return _batches(once, "append", out, state).drop("batch")
