"""The decision log on storage: append-only, one folder per write batch, cut
by a fixed hash bucket of the reviewer.

Layout ``<root>/batch=<id>/bucket=<b>/part-*.csv``.  A batch only ever
(over)writes its own folder, so a retried batch -- e.g. a streaming micro-batch
replayed after a lost executor -- replaces its earlier output instead of
duplicating it; batch names of different writers never meet (streams use their
query id).  A batch has files by bucket, not by reviewer, so many reviewers do
not become many small files, and reading one reviewer's log prunes to their
bucket.  ``compact`` rewrites many batches as one, in place if asked.

Text is RFC 4180 CSV: quotes are doubled, and free text may hold line breaks,
quotes, backslashes and surrounding blanks.
"""
from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordfold.schemas import ANNOTATIONS
from recordfold.session import materialised
from recordfold.sources.ingest import empty

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CSV_OPTIONS = {"header": "true", "timestampNTZFormat": TS_FORMAT, "emptyValue": "", "quote": '"', "escape": '"',
               "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
BUCKETS = 16
#: Folder of the lists of replaced batches (hidden from reads of the log), and
#: how the names of compacted batches begin.
COMPACTIONS, COMPACTED = "_compactions", "compacted-"

COLUMNS = [f.name for f in ANNOTATIONS.fields]
READ_SCHEMA = T.StructType(ANNOTATIONS.fields + [T.StructField("batch", T.StringType(), True),
                                                 T.StructField("bucket", T.IntegerType(), True)])


def bucket_of(user: Column) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int")


def append_decisions(decisions: DataFrame, root: str, batch_id: str | int | None = None) -> None:
    """Append decisions (ANNOTATIONS columns) to the log under ``root`` as one
    batch; writing the same ``batch_id`` again replaces that batch."""
    if batch_id is None:
        batch_id = uuid.uuid4().hex
    # rebalance: rows of a bucket come together, and AQE cuts a large bucket (a
    # hot reviewer) into several tasks and files
    (decisions.select(*COLUMNS, bucket_of(F.col("user")).alias("bucket")).hint("rebalance", "bucket")
     .write.mode("overwrite").partitionBy("bucket")
     .options(**CSV_OPTIONS).csv(f"{root.rstrip('/')}/batch={batch_id}"))


def stamp_now(decisions: DataFrame) -> DataFrame:
    """Give incoming decisions a UTC timestamp truncated to the second."""
    now = F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")
    return decisions.withColumn("timestamp", now)


def _compactions(spark: SparkSession, root: str) -> tuple[int, set[str], set[str]]:
    """Number of committed compactions, their batches, and the batches they stand for
    (names of folders, which a read of the log lists anyway)."""
    try:
        rows = spark.read.parquet(f"{root.rstrip('/')}/{COMPACTIONS}").select("v", "batch", "replaced").collect()
    except AnalysisException:  # none yet
        return 0, set(), set()
    return max(r.v for r in rows), {r.batch for r in rows}, {r.replaced for r in rows}


def _read(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the live batches.  A compacted batch counts once its list of
    replaced batches is there, and from then on these no longer do: the list is
    one file, which appears whole or not at all."""
    try:
        rows = spark.read.schema(READ_SCHEMA).options(**CSV_OPTIONS).csv(root)
    except AnalysisException:  # absent root: nothing written yet
        return empty(spark, READ_SCHEMA)
    _, compacted, replaced = _compactions(spark, root)
    live = ~F.startswith("batch", F.lit(COMPACTED)) | F.col("batch").isin(*compacted)
    return rows.where(live & ~F.col("batch").isin(*replaced)) if replaced else rows.where(live)


def read_all_decisions(spark: SparkSession, root: str) -> DataFrame:
    """Every reviewer's log as one table; absent log -> empty table."""
    return _read(spark, root).select(*COLUMNS)


def read_user_decisions(spark: SparkSession, root: str, user: str) -> DataFrame:
    """One reviewer's log (partition-pruned to their bucket)."""
    rows = _read(spark, root)
    return rows.where((F.col("bucket") == bucket_of(F.lit(user))) & (F.col("user") == user)).select(*COLUMNS)


def compact(spark: SparkSession, root: str, target: str | None = None) -> None:
    """Rewrite all live batches as one, under ``target`` (a new root) or in
    place.  In place the old folders stay for the readers that have them open;
    readers that come later see the new batch instead, never both.  A batch
    written again afterwards (a replayed stream batch) stays replaced.  Of two
    compactions at once the second one fails."""
    if target is not None:
        append_decisions(read_all_decisions(spark, root), target)
        return
    version, _, _ = _compactions(spark, root)
    rows = _read(spark, root)
    names = rows.select("batch").distinct()  # partition values: a row per folder
    batch = f"{COMPACTED}{uuid.uuid4().hex}"
    replaced = materialised(names, "compacted")
    append_decisions(rows.join(replaced, "batch", "left_semi").select(*COLUMNS), root, batch)
    replaced.select(F.lit(batch).alias("batch"), F.col("batch").alias("replaced")).coalesce(1) \
        .write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{COMPACTIONS}/v={version + 1}")


def export_csv(decisions: DataFrame, path: str) -> None:
    """Write the consolidated log as CSV with a header (one folder)."""
    decisions.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


# ---------------------------------------------------- logs of a file per reviewer

#: Folders that the files of reviewers are dealt to: enough that Spark lists them in tasks.
FOLDERS = 64
#: Bytes of a reviewer's lines that a task holds.
HELD_BYTES = 1 << 20


def _local_folder(spark: SparkSession, root: str) -> str | None:
    """``root`` as a path that Python can open (a local or mounted folder), else None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_reviewer_files(decisions: DataFrame, root: str) -> None:
    """Write the log as one CSV file per reviewer, as ``read_reviewer_files`` reads
    it from ``<root>/*``: a header, UTC timestamps with their offset, doubled
    quotes, rows in (timestamp, seq) order and no ``seq``.

    In a local or mounted folder Python tasks write the files, in ``FOLDERS``
    folders: Hadoop's local files start two processes for each (their
    permissions), which takes far longer than the lines.  A file is renamed when it is
    complete, and a task that runs again replaces its files.  Elsewhere Spark
    writes a folder per reviewer."""
    spark = decisions.sparkSession
    names = [c for c in COLUMNS if c != "seq"]
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
    rows = decisions.select(stamp.alias("timestamp"), *[c for c in names if c != "timestamp"], F.col("user").alias("reviewer"), "seq") \
        .repartition("reviewer").sortWithinPartitions("reviewer", "timestamp", "seq").drop("seq")
    folder = _local_folder(spark, root)
    if folder is None:
        rows.write.partitionBy("reviewer").options(**CSV_OPTIONS).csv(root)
        return

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    header, folders, held = (",".join(names) + "\n").encode(), FOLDERS, HELD_BYTES

    # of its own: executors need not have this package
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import os
        import uuid
        import zlib
        from urllib.parse import quote
        user, lines, size, temporary, count = None, [], 0, f".{uuid.uuid4().hex}", 0

        def place(user: bytes) -> str:
            return f"{folder}/f{zlib.crc32(user) % folders:02d}"

        def flush(done: bool) -> None:
            nonlocal lines, size, count
            path = f"{place(user)}/{temporary}"
            try:
                out = open(path, "ab")
            except FileNotFoundError:
                os.makedirs(place(user), exist_ok=True)
                out = open(path, "ab")
            with out:
                out.write(b"".join(lines))
            if done:
                name = quote(user, safe="") or "__none__"
                if len(name) > 200:  # too long for a file's name
                    name = name[:100] + hashlib.sha256(user).hexdigest()
                os.replace(path, f"{place(user)}/reviewer={name}.csv")
                count += 1
            lines, size = [], 0
        for b in batches:
            for u, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if u != user:
                    if user is not None:
                        flush(True)
                    user, lines, size = u, [header], 0
                lines.append(line)
                size += len(line)
                if size >= held:
                    flush(False)
        if user is not None:
            flush(True)
        yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})
    line = F.concat(F.concat_ws(",", *[cell(c) for c in names]), F.lit("\n"))
    lines = rows.select(F.coalesce("reviewer", F.lit("")).cast("binary").alias("reviewer"), line.cast("binary").alias("line"))
    lines.mapInArrow(write, "files bigint").write.format("noop").mode("overwrite").save()


def _header(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns named by the first line of a file under ``path``, or None
    where a line is not enough to tell them as Spark does."""
    first = spark.read.text(path).select("value").first()
    if first is None or first.value.count('"') % 2:
        return None
    names = next(csv.reader([first.value.lstrip("\ufeff")]), [])
    if not names or "" in names or len({n.lower() for n in names}) < len(names):
        return None
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_reviewer_files(spark: SparkSession, path: str) -> DataFrame:
    """Logs kept as one CSV file per reviewer: a header, timestamps with a zone
    offset, doubled quotes, no ``seq``.  The append order is the line order of a
    file: a file is parsed whole by one task, so the row number inside its
    partition follows it, and ``seq`` is that number.

    Timestamps become UTC without a zone.  Missing columns are NULL, as is a
    timestamp that can't be read."""
    names = [c for c in COLUMNS if c != "seq"]
    # columns by name: every file's header is its own
    reader = spark.read.option("header", "true").option("inferSchema", "false").option("enforceSchema", "false") \
        .options(**{k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "timestampNTZFormat")}).option("inputBufferSize", "16384")
    header = _header(spark, path)  # Spark's own look at it goes through all files on the driver
    lines = (reader if header is None else reader.schema(header)).csv(path)
    have = set(lines.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in names]
    rows = lines.select(*cols, F.monotonically_increasing_id().alias("seq"))
    stamp = F.to_utc_timestamp(F.try_to_timestamp("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return rows.withColumn("timestamp", stamp).select(*COLUMNS)
