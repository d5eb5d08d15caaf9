"""Position of a row inside its group (0, 1, 2, ... in a given order), safe
for hot groups.

A plain ``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a
group to one task; one stay holding a third of all doses would then run in a
single task.  Here the group is first split into *ordered buckets* (a value
that never decreases along the order, e.g. the day of administration or the
leading sort column): rows are numbered inside (group, bucket) in parallel,
the bucket sizes are summed into offsets on the small (group, bucket) count
table, and offset + local number is the position.  The local window output is
already partitioned by (group, bucket), so only the small offsets side moves
for the final join.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordfold.session import materialised


def positional_index(df: DataFrame, group: Sequence[Column | str], order: Sequence[Column | str],
                     bucket: Column | None = None, name: str = "idx") -> DataFrame:
    """Add ``name`` = 0-based position of each row within ``group`` by ``order``.

    ``bucket`` must be non-decreasing along ``order`` within a group (rows of a
    smaller bucket come first).  Without it, a single window is used.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if bucket is None:
        w = Window.partitionBy(*group).orderBy(*order_cols)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    # Struct keys: a NULL member still makes a non-NULL key, so rows whose group
    # or bucket is NULL are numbered like any other (a NULL bucket comes first).
    g, b = "_pos_group", "_pos_bucket"
    x = df.withColumn(g, F.struct(*group)).withColumn(b, F.struct(bucket.alias("b")))
    w_local = Window.partitionBy(g, b).orderBy(*order_cols)
    local = x.withColumn("_pos_local", (F.row_number().over(w_local) - 1).cast("bigint"))
    counts = x.groupBy(g, b).agg(F.count(F.lit(1)).alias("_pos_n"))
    w_prev = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(g, b, F.coalesce(F.sum("_pos_n").over(w_prev), F.lit(0)).alias("_pos_off"))
    out = local.join(offsets, [g, b])
    return out.withColumn(name, (F.col("_pos_off") + F.col("_pos_local")).cast("bigint")) \
        .drop(g, b, "_pos_local", "_pos_off")


def ranged_index(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """``positional_index`` without a bucket from the caller, for any order: rows
    are cut into ranges of (group, order) by Spark's sampling and sorted in
    their ranges, and the positions are the rows' places there plus the counts
    of the ranges before, a small table of a row per group and range.  A group
    of any size spreads over ranges (no ``group``: all rows are one).  Rows equal
    in group and order share a range and follow each other in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    at, part = "_pos_at", "_pos_part"
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    ranged = materialised(ranged, "ranged").withColumn(part, F.shiftright(at, 33))  # the partition's number
    g = F.struct(*group) if group else F.struct(F.lit(0))
    ranged = ranged.withColumn("_pos_group", g)
    counts = ranged.groupBy("_pos_group", part).agg(F.count(F.lit(1)).alias("_pos_n"), F.min(at).alias("_pos_first"))
    before = Window.partitionBy("_pos_group").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pos_group", part, "_pos_first", F.coalesce(F.sum("_pos_n").over(before), F.lit(0)).alias("_pos_before"))
    return ranged.join(offsets, ["_pos_group", part]) \
        .withColumn(name, (F.col("_pos_before") + F.col(at) - F.col("_pos_first")).cast("bigint")) \
        .drop("_pos_group", part, at, "_pos_first", "_pos_before")
