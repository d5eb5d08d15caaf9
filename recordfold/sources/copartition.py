"""Tables of a record written once, bucketed and sorted by (patient, stay).

Spark then aggregates them per stay and joins them to each other without an
exchange, as often as records are built from them.  A bucket is one file (rows
are dealt by the bucket's own hash first), however many tasks wrote it.  Dealt
by fewer columns than the key (the stay alone, where a stay has one patient, or
the patient, whose stays become one row) a table saves the exchange that gave it
that column, or the one that gathers by it.
"""
from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from recordfold.session import scratch_path

KEY = ("patient_id", "id_sejour")
#: What lets a plan use the buckets and their order.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
            "spark.sql.execution.replaceHashWithSortAgg": "true"}
#: Writes submitted at a time.
JOBS = 4


def by_stay(df: DataFrame, label: str, buckets: int | None = None, path: str | None = None, by: Sequence[str] = KEY) -> DataFrame:
    """``df`` (with patient_id and id_sejour) as a bucketed table, under ``path``
    or a new folder of the shared scratch folder.  Tables meet without an
    exchange when their ``buckets`` are equal (default: the session's shuffle
    partitions) and they are dealt ``by`` the same columns of the key; rows
    without a stay go to a bucket by their patient.

    The session is told that a join may use such buckets when it has more keys
    than ``by`` (an item of a stay), that a bucket's file is sorted, and that
    sorted rows are aggregated as they come: lists by stay are then built row
    by row, without a hash table or a sort that a large bucket would spill."""
    spark = df.sparkSession
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    df.repartition(n, *by).write.format("parquet").bucketBy(n, *by).sortBy(*KEY) \
        .option("compression", "zstd").option("path", path or scratch_path(spark, label)).saveAsTable(name)
    table = spark.table(name)
    for c in KEY:  # columns of their own, not the catalogue's: unions of such tables keep the buckets too
        table = table.withMetadata(c, {"recordfold.key": True})
    return table


def tables_by_stay(tables: Mapping[str, DataFrame], buckets: int | None = None, by: Sequence[str] = KEY) -> dict[str, DataFrame]:
    """Every table that belongs to stays bucketed, the others as they are.  The
    writes are independent jobs, a few of them submitted at a time."""
    of_stays = [name for name, df in tables.items() if set(KEY) <= set(df.columns)]
    with ThreadPoolExecutor(JOBS) as pool:
        written = dict(zip(of_stays, pool.map(lambda name: by_stay(tables[name], name, buckets, by=by), of_stays)))
    return {name: written.get(name, df) for name, df in tables.items()}
