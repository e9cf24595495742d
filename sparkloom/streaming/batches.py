"""The dialect over Structured Streaming.

The dialect has no unbounded tables, so a stream is queried as its micro-batches:
each is registered under a name, and the query's result is handed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Engine


def run_on_batches(engine: Engine, stream: DataFrame, name: str, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``query`` on every micro-batch of ``stream``, registered as ``name``.

    ``sink`` gets the result and the batch's number; with a sink that ignores
    numbers it has seen, results count once after a restart from ``checkpoint``.
    """

    def each(batch: DataFrame, number: int) -> None:
        engine.register_frame(name, batch)
        sink(engine.sql(query), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
