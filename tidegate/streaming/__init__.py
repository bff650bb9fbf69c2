"""Row pipelines on Structured Streaming.

Every stage but limit and offset works row by row, so the same lowering applies to a streaming
DataFrame; policies skip and error sinks do too.  Ordinals, and with them limit, offset and abort,
need the order of a bounded input and are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidegate.builder import Rows, plain
from tidegate.nodes import AnalysisFault


def stream(rows: Rows, write: Callable[[str, DataFrame, int], None], checkpoint: str, *, sinks: tuple[str, ...] = ("out",), available_now: bool = True) -> StreamingQuery:
    """Starts a pipeline over a streaming DataFrame; ``write`` gets (sink, rows, batch number), and failed rows come as the sink ``errors``.

    Each micro-batch is exactly what the pipeline gives for it as a bounded table.  A batch may be
    repeated after a failure, with the same number, so ``write`` should overwrite by batch number.
    """
    if not rows.df.isStreaming:
        raise AnalysisFault("stream needs a streaming DataFrame")
    for s in rows.stages:
        if s.op in ("limit", "offset"):
            raise AnalysisFault(f"{s.op} needs a bounded source", s.pos)
    if rows.policy == "abort":
        raise AnalysisFault("a stream needs the policy skip or an error sink")
    from dataclasses import replace

    def batch(df: DataFrame, number: int) -> None:
        low = replace(rows, df=df, order_by=None).lowered(sinks=sinks)
        for s in sinks:
            write(s, plain(low, s), number)
        if rows.policy != "skip":
            write("errors", low.envelopes().drop("#ord", "ordinal", "offset"), number)

    writer = rows.df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
