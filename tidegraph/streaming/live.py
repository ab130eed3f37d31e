"""Live forms of the temporal operators for Structured Streaming (an addition: the blueprint's source is batch only).

Inputs are streams of (head, relation, ts timestamp, seq, action). State is kept for each statement: its last action and
the time its interval began, so it grows with the number of statements and not with that of events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVALS = "head string, relation string, from_ts timestamp, to_ts timestamp, final boolean"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Runs collapse and intervals close as events come; an open interval is told once, with a null end.

    Events of one trigger are ordered by (ts, seq); those older than what was seen are applied as they come.
    """
    since = state.get[0] if state.exists else None
    out = []
    events = pd.concat(list(batches)).sort_values(["ts", "seq"])
    for e in events.itertuples():
        if e.action == "A" and since is None:
            since = int(e.ts.value // 1000)
            out.append((*key, pd.Timestamp(since * 1000), pd.NaT, False))
        elif e.action == "D" and since is not None:
            out.append((*key, pd.Timestamp(since * 1000), e.ts, True))
            since = None
    state.update((since,))
    yield pd.DataFrame(out, columns=["head", "relation", "from_ts", "to_ts", "final"])


def live_intervals(events: DataFrame) -> DataFrame:
    """Collapsed runs as intervals, while events arrive."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("head", "relation").applyInPandasWithState(_advance, INTERVALS, "since bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Events by window and relation, tumbling or sliding; rows later than the watermark are not counted."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "relation").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "relation", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Session windows of each head: the live form of gap clusters."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "head").agg(F.count("*").alias("n")).select("head", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def splice_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that splices each batch of corrections into a table (J20); of one key in a batch the row of the highest seq counts."""
    from tidegraph.operators.joins import splice

    def apply(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in (key, "seq")]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(key, "r.*")
        write(splice(read(), last, key))

    return apply
