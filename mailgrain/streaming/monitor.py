"""Continuous monitoring of a landing folder with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mailgrain.operators.spam_model import SpamModel
from mailgrain.params import DEFAULTS, Params
from mailgrain.plans.process import Tables, run_batch
from mailgrain.sources.store import HistoryStore


def utc_now() -> datetime:
    return datetime.now(UTC)


def monitor(
    messages: DataFrame,
    store: HistoryStore,
    checkpoint: str,
    every: str | None = "1 hour",
    tables: Tables | None = None,
    model: SpamModel | None = None,
    params: Params = DEFAULTS,
    clock: Callable[[], datetime] = utc_now,
    retries: int = 3,
    retry_delay: float = 60.0,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Process every new message once, in batches; ``every=None`` drains and stops.

    Each micro-batch skips uids the history holds and writes its own partition
    of the history, keyed by the batch number.  A batch that fails is repeated
    after ``retry_delay`` seconds, ``retries`` times; it replaces what it wrote.
    After that the query ends, and a restarted one repeats the batch.

    With ``compact_every``, after so many batches all but the last one, which may
    yet be repeated, are merged into the base of the history.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(retries + 1):
            try:
                run_batch(batch, store, batch_id, clock(), tables, model, params)
                if compact_every and batch_id and batch_id % compact_every == 0:
                    store.compact(batch_id - 1)
                return
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(retry_delay)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def first_seen(messages: DataFrame, delay: str = "30 days") -> DataFrame:
    """Drop repeated uids in the stream itself, with state bounded by ``delay``.

    Rows that arrive later than the watermark are dropped too; :func:`monitor`
    does not need this, its history join is exact.
    """
    return messages.withWatermark("received_date", delay).dropDuplicatesWithinWatermark(["uid"])
