"""Structured Streaming: the maintained fold equals the batch fold, across
several micro-batches, and a restarted query does not duplicate output."""
import datetime as dt
import tempfile

from recordfold.operators import overlay
from recordfold.schemas import ANNOTATIONS
from recordfold.sources import decisions
from recordfold.streaming import decisions as stream
from helpers import rows

T0 = dt.datetime(2025, 2, 1, 8, 0, 0)


def _inbox(spark, n_files=3):
    inbox = tempfile.mkdtemp(prefix="inbox-")
    acts = ["validé", "rejeté", "modifié", "annulé", "supprimé"]
    for f in range(n_files):
        data = [(T0 + dt.timedelta(minutes=10 * f + i), "u%d" % (i % 2), "P1", "S1", "suggestion",
                 "s%d" % (i % 4), acts[(i + f) % 5], "C%d" % f if i % 3 == 0 else None, None, None, None,
                 100 * f + i) for i in range(12)]
        spark.createDataFrame(data, ANNOTATIONS).coalesce(1).write.mode("append") \
            .options(**decisions.CSV_OPTIONS).csv(inbox)
    return inbox


def test_streamed_fold_equals_batch(spark):
    inbox = _inbox(spark)
    state, ckpt = tempfile.mkdtemp(prefix="state-"), tempfile.mkdtemp(prefix="ckpt-")
    stream.maintain_latest(spark, inbox, state, ckpt, max_files=1).awaitTermination()
    got = stream.read_latest_state(spark, state)
    batch = overlay.latest_actions(stream_source(spark, inbox))
    cols = ["user", "item_id", "timestamp", "action", "code"]
    assert rows(got, *cols) == rows(batch, *cols)
    # three files, one per trigger -> three micro-batches were written
    assert spark.read.parquet(state).select("batch").distinct().count() == 3
    packed = tempfile.mkdtemp(prefix="packed-")
    stream.compact_state(spark, state, packed)
    assert rows(stream.read_latest_state(spark, packed), *cols) == rows(batch, *cols)


def test_second_checkpoint_adds_and_never_overwrites(spark):
    """Two inboxes with two checkpoints on one log and one state: nothing is lost,
    and a newer action from the second query wins."""
    def inbox(rows_):
        path = tempfile.mkdtemp(prefix="inbox-")
        spark.createDataFrame(rows_, ANNOTATIONS).coalesce(1).write.mode("append").options(**decisions.CSV_OPTIONS).csv(path)
        return path

    def row(minute, item, action, comment, seq):
        return (T0 + dt.timedelta(minutes=minute), "u1", "P1", "S1", "suggestion", item, action, None, None, None, comment, seq)
    note = 'first line\n "quoted", back\\slash \n'
    first = inbox([row(0, "a", "validé", note, 0), row(1, "b", "rejeté", None, 1), row(2, "c", "validé", "x", 2)])
    second = inbox([row(9, "b", "annulé", None, 3)])
    root, state = tempfile.mkdtemp(prefix="log-"), tempfile.mkdtemp(prefix="state-")
    for box in (first, second):
        stream.ingest_decisions(spark, box, root, tempfile.mkdtemp(prefix="ckpt-")).awaitTermination()
        stream.maintain_latest(spark, box, state, tempfile.mkdtemp(prefix="ckpt-")).awaitTermination()
    log = decisions.read_all_decisions(spark, root)
    assert sorted((r.seq, r.item_id, r.commentaire) for r in log.collect()) == [
        (0, "a", note), (1, "b", None), (2, "c", "x"), (3, "b", None)]
    got = {r.item_id: r.action for r in stream.read_latest_state(spark, state).collect()}
    assert got == {"a": "validé", "b": "annulé", "c": "validé"}
    target = tempfile.mkdtemp(prefix="log-")
    decisions.compact(spark, root, target)
    assert rows(decisions.read_user_decisions(spark, target, "u1"), "seq") == rows(log, "seq")


def stream_source(spark, inbox):
    return spark.read.schema(ANNOTATIONS).options(**decisions.CSV_OPTIONS).csv(inbox)


def test_ingest_restart_does_not_duplicate(spark):
    inbox = _inbox(spark, 2)
    root, ckpt = tempfile.mkdtemp(prefix="log-"), tempfile.mkdtemp(prefix="ckpt-")
    stream.ingest_decisions(spark, inbox, root, ckpt, max_files=1).awaitTermination()
    first = decisions.read_all_decisions(spark, root).count()
    stream.ingest_decisions(spark, inbox, root, ckpt, max_files=1).awaitTermination()
    assert decisions.read_all_decisions(spark, root).count() == first == 24


def test_worklist_equals_the_overlay_after_every_batch(spark):
    from pyspark.sql import functions as F
    inbox, root, ckpt = (tempfile.mkdtemp(prefix="worklist-") for _ in range(3))
    items = spark.range(12).select(
        F.concat(F.lit("u"), (F.col("id") % 2).cast("string")).alias("user"), F.lit("P1").alias("patient_id"), F.lit("S1").alias("id_sejour"),
        F.concat(F.lit("s"), F.floor(F.col("id") / 2).cast("string")).alias("suggestion_id"), F.lit("B").alias("code"), F.lit("base").alias("libelle"),
        F.lit("50").alias("confiance"))
    acts = ["validé", "modifié", "annulé", "rejeté"]
    for turn in range(3):
        data = [(T0 + dt.timedelta(minutes=turn), f"u{turn % 2}", "P1", "S1", "suggestion", f"s{i}", acts[(i + turn) % 4], f"C{turn}", f"L{turn}",
                 None, None, 10 * turn + i) for i in range(4)]
        spark.createDataFrame(data, ANNOTATIONS).coalesce(1).write.mode("append").options(**decisions.CSV_OPTIONS).csv(inbox)
        stream.maintain_worklist(spark, inbox, items, root, ckpt).awaitTermination()
        want = overlay.suggestion_status(items, overlay.latest_actions(stream_source(spark, inbox)))
        cols = [*stream.ITEM, *stream.OVERLAID]
        assert rows(stream.read_worklist(spark, items, root), *cols) == rows(want, *cols)
    # a batch writes what it decided on, not the whole list
    assert spark.read.parquet(root).groupBy("batch").count().agg(F.max("count")).first()[0] == 4
