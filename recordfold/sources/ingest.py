"""Tolerant typed load of the reference tables.

A missing or unreadable source becomes an empty table with the declared
columns (and a warning); missing columns are added as NULL; identifiers are
normalised to text; rows that cannot be attached to a patient (or, outside
documents/fiches/observations, to a stay) are dropped.  All of it is one
projection and one filter on top of the scan, so pushdown and pruning still
reach the files.
"""
from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordfold.functions.scalars import id_string, nan_to_null, safe_bool, safe_int
from recordfold.schemas import ALLOW_MISSING_STAY, BOOL_TEXT, INT_TEXT, TABLES, is_id_column

log = logging.getLogger(__name__)

#: What an absent path or a damaged footer raises when a source is opened.
UNREADABLE = (AnalysisException, PySparkException, Py4JJavaError)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  **options) -> DataFrame:
    """Read ``path``; if it is absent or unreadable, return an empty table.

    CSV is read as text columns with a header and conformed by *name* (a
    positional schema would shift columns when one is missing).
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    for k, v in options.items():
        reader = reader.option(k, v)
    try:
        df = reader.load(path)
        df.schema  # noqa: B018  (forces file listing / footer read)
    except UNREADABLE as e:
        log.warning("%s unreadable or absent (%s): empty table", path, type(e).__name__)
        return empty(spark, schema)
    return conform(df, schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema`` by name: add missing columns as NULL,
    normalise identifiers, turn NaN into NULL and cast the rest (tolerantly)."""
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name not in present:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        src_t = present[f.name]
        c = nan_to_null(F.col(f.name), src_t) if isinstance(src_t, (T.FloatType, T.DoubleType)) \
            else F.col(f.name)
        if is_id_column(f.name):
            c = id_string(F.col(f.name), src_t)
        elif f.name in INT_TEXT and not isinstance(src_t, T.StringType):
            # read as a number first: 85.0 is 85, not the unparsable text '85.0'
            c = F.when(c.isNotNull(), safe_int(F.col(f.name), src_t, None)).cast("string")
        elif f.name in BOOL_TEXT and not isinstance(src_t, T.StringType):
            c = F.when(c.isNotNull(), safe_bool(F.col(f.name), src_t)).cast("string")
        elif src_t != f.dataType:
            c = c.try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def drop_unattached(df: DataFrame, table: str) -> DataFrame:
    """Drop rows without patient; without stay too, except where a table allows it."""
    cond = F.col("patient_id").isNotNull()
    if "id_sejour" in df.columns and table not in ALLOW_MISSING_STAY:
        cond = cond & F.col("id_sejour").isNotNull()
    return df.where(cond)


def load_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet",
               position: bool = False) -> DataFrame:
    """Load one reference table ``<base>/<name>.<fmt>`` the tolerant way.

    With ``position``, a ``pos`` column keeps the row's place in its file
    (lists in the record follow file order).
    """
    path = f"{base.rstrip('/')}/{name}.{fmt}"
    df = read_tolerant(spark, path, TABLES[name], fmt)
    if position:
        df = _positioned(spark, path, TABLES[name], fmt, df)
    return drop_unattached(df, name)


def _opened(reader: DataFrameReader, path: str) -> DataFrame | None:
    try:
        df = reader.load(path)
        df.schema  # noqa: B018
        return df
    except UNREADABLE:
        return None


def load_files(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """A table kept as a folder of files, loaded file by file: the rows of the
    readable files, and the rejects (file, size, reason) -- files that gave no
    row.  Files of no bytes are neither.  One pass over the files for each of
    the two."""
    schema = TABLES[name]
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) \
            .select(F.col("path").alias("file"), F.col("length").alias("size"))
    except UNREADABLE as e:
        log.warning("%s absent (%s): empty table", path, type(e).__name__)
        return empty(spark, schema), spark.createDataFrame([], "file string, size bigint, reason string")
    reason = F.lit("no_row_read").alias("reason")
    reader = reader.option("header", True) if fmt == "csv" else reader
    raw = _opened(reader, path) or _opened(reader.option("mergeSchema", "true"), path)  # the file asked for columns may be the damaged one
    if raw is None:
        return empty(spark, schema), listed.select("file", "size", reason)
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")  # noqa: E731  (readers spell a scheme differently)
    read = raw.select(plain(F.col("_metadata.file_path")).alias("read")).distinct()
    rejects = listed.join(read, plain(F.col("file")) == F.col("read"), "left_anti").select("file", "size", reason)
    return drop_unattached(conform(raw, schema), name), rejects


def _positioned(spark, path, schema, fmt, conformed):
    """Re-read with the file position: Parquet has a row index per file; other
    formats fall back to a per-read ordinal (stable for an unchanged listing).
    An absent source keeps its empty table, with a NULL position."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    try:
        raw = reader.load(path)
        raw.schema  # noqa: B018
    except UNREADABLE:
        return conformed.withColumn("pos", F.lit(None).cast("bigint"))
    if fmt == "parquet":
        raw = with_position(raw)
    else:
        raw = raw.withColumn("pos", F.struct(F.col("_metadata.file_path").alias("_file"),
                                             F.monotonically_increasing_id().alias("_row")))
    target = T.StructType(schema.fields + [T.StructField("pos", raw.schema["pos"].dataType)])
    return conform(raw, target)


def with_position(df: DataFrame) -> DataFrame:
    """Attach the row's position in its source (file order is data: lists keep it).

    Uses the Parquet row index plus file name, so it is stable across re-reads.
    """
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.row_index").alias("_row")) \
        .withColumn("pos", F.struct("_file", "_row")).drop("_file", "_row")


def write_tables(tables: dict[str, DataFrame], base: str, fmt: str = "parquet",
                 mode: str = "errorifexists") -> dict[str, int]:
    """Write every table to ``<base>/<name>.<fmt>``; returns nothing heavy --
    the row counts come from a second, cheap pass over the written files."""
    out = {}
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}.{fmt}"
        options = {"compression": "zstd"} if fmt == "parquet" else {}
        df.write.mode(mode).format(fmt).options(**options).save(path)
        out[name] = df.sparkSession.read.format(fmt).load(path).count()
    return out
