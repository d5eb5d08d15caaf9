"""Structured Streaming for the decision log.

T1 ``ingest_decisions``: decision files dropped in an inbox are appended to
the log, exactly once through the query's checkpoint.

T2 ``maintain_latest``: the last action per item, maintained as a streaming
aggregate (the same skip-NULL fold as the batch operator) in update mode.  Each
micro-batch's changed keys are appended to a state table.  A state row keeps,
for every value, the order key it was chosen by, so rows of any number of
batches, and of any number of queries over the same state, fold to the same
result as the whole log (``read_latest_state``); ``compact_state`` rewrites
them as one row per item.  There is no watermark on purpose: any old item can
still be revised, so the state is unbounded -- it holds one row per item.

``maintain_worklist``: the reviewers' worklists (J2), kept up to date from the
changed keys of each micro-batch: only the items that a batch decided on are
overlaid again and appended to the worklist's changes.  ``read_worklist`` puts
the last change of an item over the untouched list, without the log or a fold.

Folders are named by the query's own id and its batch number: another query, or
the same inbox with a new checkpoint, never overwrites earlier folders, and a
replayed batch overwrites only itself.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordfold.operators.overlay import LOG_KEYS, LOG_VALUES, last_ordering, suggestion_status
from recordfold.schemas import ANNOTATIONS
from recordfold.sources.decisions import COLUMNS, CSV_OPTIONS, append_decisions


def read_inbox(spark: SparkSession, inbox: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ANNOTATIONS).options(**CSV_OPTIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(inbox)


def batch_name(batch: DataFrame, batch_id: int) -> str:
    """Query id (kept in its checkpoint) and batch number."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("a streaming query's id is needed to name its batch")
    return f"{query}-{batch_id}"


def ingest_decisions(spark: SparkSession, inbox: str, log_root: str, checkpoint: str,
                     max_files: int | None = None) -> StreamingQuery:
    """Append every decision arriving in ``inbox`` to the log under ``log_root``;
    a micro-batch is one log batch (a replay overwrites it)."""
    stream = read_inbox(spark, inbox, max_files).select(*COLUMNS)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_decisions(batch, log_root, batch_name(batch, batch_id))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def _keyed(log: DataFrame) -> DataFrame:
    """Per item and value: the largest (order, value) among non-null values."""
    order = last_ordering(("timestamp", "seq"))
    present = F.lit(True)
    for k in LOG_KEYS:
        present = present & F.col(k).isNotNull()
    best = [F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v")))).alias(c) for c in LOG_VALUES]
    return log.where(present).groupBy(*LOG_KEYS).agg(*best)


def maintain_latest(spark: SparkSession, inbox: str, state_root: str, checkpoint: str,
                    max_files: int | None = None) -> StreamingQuery:
    """Keep the folded last action per (user, patient, stay, item) up to date."""
    folded = _keyed(read_inbox(spark, inbox, max_files))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_root.rstrip('/')}/batch={batch_name(batch, batch_id)}")

    return (folded.writeStream.outputMode("update").foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _state(spark: SparkSession, state_root: str) -> DataFrame:
    rows = spark.read.option("basePath", state_root).parquet(f"{state_root.rstrip('/')}/batch=*")
    return rows.groupBy(*LOG_KEYS).agg(*[F.max(c).alias(c) for c in LOG_VALUES])


def read_latest_state(spark: SparkSession, state_root: str) -> DataFrame:
    """Current state: per key and value, the latest non-null one over all batches."""
    return _state(spark, state_root).select(*LOG_KEYS, *[F.col(c)["v"].alias(c) for c in LOG_VALUES])


def compact_state(spark: SparkSession, state_root: str, target: str) -> None:
    """Rewrite the state under ``state_root`` as one batch under ``target`` (a new root)."""
    _state(spark, state_root).write.mode("errorifexists").parquet(f"{target.rstrip('/')}/batch=compacted")


ITEM = ("user", "patient_id", "id_sejour", "suggestion_id")
OVERLAID = ("code", "libelle", "confiance", "status", "amended")


def maintain_worklist(spark: SparkSession, inbox: str, items: DataFrame, root: str, checkpoint: str,
                      max_files: int | None = None) -> StreamingQuery:
    """Keep the worklists of ``items`` (reviewer x proposed code, ITEM their key)
    up to date with the decisions arriving in ``inbox``: a micro-batch writes the
    items it decided on with their new state.  One query per ``root``; a replayed
    batch overwrites its own folder."""
    def change(batch: DataFrame, batch_id: int) -> None:
        latest = batch.select(*LOG_KEYS, *[F.col(c)["v"].alias(c) for c in LOG_VALUES])
        keys = latest.select(*LOG_KEYS).withColumnRenamed("item_id", ITEM[-1])
        changed = suggestion_status(items.join(keys, list(ITEM), "left_semi"), latest)
        changed.select(*ITEM, *OVERLAID, F.lit(batch_id).cast("bigint").alias("turn")) \
            .write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_name(batch, batch_id)}")

    return (_keyed(read_inbox(spark, inbox, max_files)).writeStream.outputMode("update").foreachBatch(change)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_worklist(spark: SparkSession, items: DataFrame, root: str) -> DataFrame:
    """``items`` with their current state: the last change of each, or pending."""
    changes = spark.read.option("basePath", root).parquet(f"{root.rstrip('/')}/batch=*")
    last = changes.groupBy(*ITEM).agg(F.max_by(F.struct(*OVERLAID), "turn").alias("_now"))
    nothing = spark.createDataFrame([], ANNOTATIONS)
    return suggestion_status(items, nothing).join(last, list(ITEM), "left").withColumns(
        {c: F.when(F.col("_now").isNotNull(), F.col("_now")[c]).otherwise(F.col(c)) for c in OVERLAID}).drop("_now")
