"""Registered queries: streaming ingest (T1) and the streaming fold (T2),
driven to completion with ``availableNow`` over the decision log derived from
``events``; their results must equal the batch operators'."""
from __future__ import annotations

from recordfold.plans import adapters as ad
from recordfold.plans import q_access  # noqa: F401  (registers export_all, reused as oracle)
from recordfold.plans.queries import ORACLE, register, ts_text, worklist_items
from recordfold.schemas import ANNOTATIONS
from recordfold.session import materialised, scratch_path
from recordfold.sources import decisions
from recordfold.streaming import decisions as stream

INBOX_FILES = 6
FILES_PER_BATCH = 2


def _fill_inbox(spark, sf_dir) -> str:
    """Write the decision log as several CSV files (several micro-batches)."""
    inbox = scratch_path(spark, "inbox")
    log = ad.decision_log(spark, sf_dir).select(*[f.name for f in ANNOTATIONS.fields])
    log.repartition(INBOX_FILES, "seq").write.options(**decisions.CSV_OPTIONS).csv(inbox)
    return inbox


@register("stream_latest_actions", ORACLE["latest_actions"])
def q_stream_latest_actions(spark, sf_dir):
    inbox = _fill_inbox(spark, sf_dir)
    state = scratch_path(spark, "latest-state")
    q = stream.maintain_latest(spark, inbox, state, scratch_path(spark, "ckpt-latest"), FILES_PER_BATCH)
    q.awaitTermination()
    la = stream.read_latest_state(spark, state)
    return la.select("user", "patient_id", "id_sejour", "item_id", ts_text("timestamp").alias("last_ts"),
                     "item_type", "action", "code", "libelle", "type_code", "commentaire")


@register("stream_worklist", ORACLE["suggestion_status"])
def q_stream_worklist(spark, sf_dir):
    """The worklists kept up to date batch by batch, as ``suggestion_status`` has them."""
    items = materialised(worklist_items(spark, sf_dir), "worklist-items")
    inbox, root = _fill_inbox(spark, sf_dir), scratch_path(spark, "worklist")
    stream.maintain_worklist(spark, inbox, items, root, scratch_path(spark, "ckpt-worklist"), FILES_PER_BATCH).awaitTermination()
    return stream.read_worklist(spark, items, root).select(*stream.ITEM, *stream.OVERLAID)


@register("stream_ingest", ORACLE["export_all"])
def q_stream_ingest(spark, sf_dir):
    inbox = _fill_inbox(spark, sf_dir)
    root = scratch_path(spark, "decision-log")
    q = stream.ingest_decisions(spark, inbox, root, scratch_path(spark, "ckpt-ingest"), FILES_PER_BATCH)
    q.awaitTermination()
    back = decisions.read_all_decisions(spark, root)
    return back.select(ts_text("timestamp").alias("timestamp"), "user", "patient_id", "id_sejour",
                       "item_type", "item_id", "action", "code", "libelle", "type_code",
                       "commentaire", "seq")
