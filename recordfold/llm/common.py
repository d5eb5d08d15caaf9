"""Helpers shared by the training-data operators."""
from __future__ import annotations

import pathlib
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordfold.session import scratch_path

#: Rows and bytes of one Arrow batch handed to a Python task.  They bound a
#: task's memory (besides one single text), never what is processed.
BATCH_ROWS = 1000
BATCH_BYTES = 8 * 1024 * 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python tasks, and see that tasks can import this package.

    Shuffle files go when the query that made them ends: an operator of several
    jobs then needs the disk of its largest one, not of all."""
    _ship(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _ship(spark: SparkSession) -> None:
    """Where executors do not have the package installed, send it to them as
    ``--py-files`` would, once per context (a file Spark itself serves)."""
    sc = spark.sparkContext
    if getattr(sc, "_recordfold_sent", False):
        return
    sc._recordfold_sent = True

    def probe(batches):
        import importlib.util
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"ok": [importlib.util.find_spec("recordfold") is not None]})
    if not all(r["ok"] for r in spark.range(1).mapInArrow(probe, "ok boolean").collect()):
        folder = pathlib.Path(__file__).resolve().parents[1]
        base = tempfile.mkdtemp(prefix="recordfold-code-")
        sc.addPyFile(shutil.make_archive(f"{base}/recordfold", "zip", folder.parent, folder.name))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage with files that outlive any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """``df``, a table as Spark wrote it, with the column ``name``: the row's
    number from 0 in the order of the part files, whatever order a scan gives
    them.  A table that isn't read from files is written first."""
    number = lambda p: F.coalesce(F.regexp_extract("_file", p, 1).try_cast("bigint"), F.lit(0))
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index")]
    try:
        rows = df.select("*", *place)
        rows.schema
    except AnalysisException:
        rows = written(df, "in-order").select("*", *place)
    files = rows.groupBy("_file").agg((F.max("_index") + 1).alias("_rows"))
    # a row per file: its part number, then its number in the task
    order = Window.orderBy(number(r"part-(\d+)"), number(r"-c(\d+)[^/]*$"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("_file", F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_file").withColumn(name, F.col("_before") + F.col("_index")).drop("_file", "_index", "_before")


def wide_partitions(df: DataFrame) -> int:
    """Partitions for an explicit ``repartition``: the session's shuffle setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def rows_to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples in the order of ``schema`` as record batches of bounded length."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
