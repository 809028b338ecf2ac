"""An extension: the revision log as a stream. Each write names its base; heads are state, stale writes are marked.

Windows over event time are Spark's own, with a watermark for late rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "doc_id long, rev long, base long, op string, accepted boolean, head long"


def _accept(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State: the head and the last revision that was no re-import."""
    head, last = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for r in rows.itertuples():
        fresh = r.base >= last
        if fresh:
            head += 1
            if r.op != "reimport":
                last = head
        out.append((key[0], head if fresh else None, r.base, r.op, fresh, head))
    state.update((head, last))
    yield pd.DataFrame(out, columns=["doc_id", "rev", "base", "op", "accepted", "head"])


def accept(writes: DataFrame) -> DataFrame:
    """writes (doc_id, seq, base, op), a stream -> each write with its revision, or not accepted if something but
    re-imports came after its base."""
    return writes.groupBy("doc_id").applyInPandasWithState(_accept, OUT, "head long, last long", "append", "NoTimeout")


def activity(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows, for a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
