"""Incremental upsert as a Structured Streaming job.

New contact files arrive in a folder; every micro-batch is upserted into
the stored table with ``foreachBatch``. Replaying a batch changes nothing: the
upsert skips records that bring nothing new. The outcomes of a batch are kept
as its first run that ended wrote them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S

from ..operators.keys import with_index
from ..operators.upsert import upsert
from ..sources.store import TruthStore


def batch_tag(stream: str, batch_id: int) -> str:
    """Name of a micro-batch's outcomes. A stream is identified by its
    checkpoint location, since batch ids restart with a new checkpoint."""
    return f"{hashlib.sha256(stream.encode()).hexdigest()[:16]}-{batch_id}"


def apply_batch(store: TruthStore, batch: DataFrame, batch_id: int, now: str | None = None,
                order_cols: list[str] | None = None, stream: str = "", **upsert_kw) -> bool:
    """Upsert one micro-batch; whether it brought anything that wasn't there.

    Outcomes are written first, to a folder named after the batch, then the
    touched buckets. After a crash between the two the batch is applied with
    the same outcomes; after one that came later everything is skipped, and
    the outcomes of the first run stay.
    """
    tag = batch_tag(stream, batch_id)
    if batch.isEmpty():
        return False
    if "_row_id" not in batch.columns:
        if not order_cols:
            raise ValueError("a stream without _row_id needs order_cols: which record comes first decides")
        batch = with_index(batch, order_cols, name="_row_id")
    touched = store.touched_buckets(batch) if S.EMAIL in batch.columns else []
    res = upsert(store.read(buckets=touched), batch, now=now, max_sn=store.max_sn(), **upsert_kw)
    outcomes, path = res.outcomes.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{store.root}/_outcomes/batch={tag}"
    new = not outcomes.where(F.col("action").isin("insert", "update")).isEmpty()
    # a run that changes nothing may be the replay of one that did: it doesn't replace what that one wrote
    outcomes.write.mode("overwrite" if new else "ignore").parquet(path)
    if new:
        store.commit(res.state, buckets=touched)
    return new


def upsert_stream(stream: DataFrame, store: TruthStore, checkpoint: str, now: str | None = None,
                  available_now: bool = True, order_cols: list[str] | None = None,
                  **upsert_kw) -> StreamingQuery:
    """Start the streaming upsert of ``stream`` into ``store``.

    ``checkpoint`` must be on shared storage (it holds the source offsets).
    ``available_now=True`` processes what is there and stops; otherwise the
    query keeps running with the default micro-batch trigger.
    """
    def each(df: DataFrame, batch_id: int) -> None:
        apply_batch(store, df, batch_id, now=now, order_cols=order_cols, stream=checkpoint, **upsert_kw)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
