"""Shared helpers: scratch tables in the cluster's shared folder, deterministic samples, row keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that become Python objects at a time.
PIECE_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the setting has no default in some versions
        found = None
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="harborline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: lost executors cost a re-read, not a recomputation.  The table goes when the
    driver ends, or before by dropped().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/harborline/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = _file_system(spark, path)
    system.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by written(), once nothing reads it."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/harborline/" in path:
            target, system = _file_system(df.sparkSession, path)
            system.delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null id: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def spread_sample(df: DataFrame, per_class: int, label: str, key: str, cells: int = 32) -> DataFrame:
    """per_class rows of each label, or all where there are fewer: those of the least key hashes, as `__order`.

    Ranks are first limited within `cells` cells of a label, so that one that holds a third of all rows is not
    ranked in one task; Spark pushes that limit below the shuffle.  A second rank sees cells * per_class rows.
    """
    ordered = df.withColumn("__order", F.xxhash64(F.col(key), F.lit("sample"))).withColumn("__cell", F.pmod(F.xxhash64(F.col(key), F.lit("cell")), F.lit(cells)))
    for keys in ([label, "__cell"], [label]):
        window = Window.partitionBy(*keys).orderBy("__order", key)
        ordered = ordered.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= per_class)
    return ordered.drop("__cell", "__rank")


def released() -> None:
    """Give memory that a task has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def in_pieces(batch: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """Slices of about PIECE_BYTES, so that few rows are Python objects at a time."""
    size = len(batch)
    step = max(1, size * PIECE_BYTES // max(1, batch.nbytes))
    for i in range(0, size, step):
        yield batch.slice(i, step)


def text_column(text: Column, kind: str, values: Callable[[list], list]) -> Column:
    """values(texts), piece by piece; the other columns of a row stay in the JVM."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [pa.array(values(piece.to_pylist()), arrow) for piece in in_pieces(batch)]
            yield pa.concat_arrays(found) if found else pa.array([], arrow)
        released()

    return F.arrow_udf(run, kind)(text)


def map_columns(df: DataFrame, inputs: list[str], schema: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Apply rows(*column lists) to each Arrow batch; it yields output tuples that follow schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in in_pieces(whole)):
            found = list(rows(*(batch.column(i).to_pylist() for i in range(len(inputs)))))
            columns = list(zip(*found)) if found else [[] for _ in kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)
        released()

    return df.select(*inputs).mapInArrow(run, schema)
