"""Queries that arrive as a stream, answered against a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators import scan, search


def answer_stream(queries: DataFrame, index: DataFrame, documents: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 10, checkpoint: str | None = None, stats: DataFrame | None = None) -> StreamingQuery:
    """Gives ``sink`` the padded top ``k`` of every micro-batch of ``query_id, lang, terms``; ``index`` has weighted postings, or with ``stats`` packed rows."""

    def run(batch: DataFrame, epoch: int) -> None:
        scored = search.best_scores(search.asked_postings(index, batch), batch, k) if stats is None else scan.best(index, stats, batch, k)
        sink(search.match(scored, batch, documents, k), epoch)

    writer = queries.writeStream.foreachBatch(run)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
