"""New pairs in, verdicts, counters and totals out, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from verdictflow.plans.cascade import Cascade, advance
from verdictflow.sources.ledger import Ledger


def start_cascade(
    candidates: DataFrame, checkpoint: str, ledger: Ledger, cascade: Cascade, *,
    clock: Callable[[int], Column], writer: str = "stream", trigger: dict | None = None,
) -> StreamingQuery:
    """``foreachBatch`` around ``plans.cascade.advance``.

    A batch is one commit of pairs, verdict rows, counters and totals; only the buckets its keys
    fall into are read and rewritten. Its number is part of the commit, so a batch that is repeated
    after a crash changes nothing if it was committed and starts over if it was not. ``writer``
    names the stream: give a stream with a new ``checkpoint`` a new name, or its numbers, which
    start again at 0, are taken for repeats. ``clock(batch_id)`` gives the time of a batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        advance(ledger, batch, cascade, clock(batch_id), writer=writer, batch=batch_id)

    return (
        candidates.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
