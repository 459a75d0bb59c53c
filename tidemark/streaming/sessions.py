"""Streaming forms of the turn and coverage operators (an extension: the batch operators are the reference)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_activity(events: DataFrame, ts: str, key: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events and speaking seconds of each key in tumbling windows, with a watermark for late rows."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))).alias("seconds"))
        .select(F.col("w.start").alias("window_start"), key, "n", "seconds")
    )


TURN = "ep bigint, speaker string, start_s double, end_s double, n_rows bigint"


def session_turns(rows: DataFrame, gap_s: float = 2.5, order: str | None = None) -> DataFrame:
    """Turns of a stream of rows (ep, at, start_s, end_s, speaker): a pause or another speaker ends a turn.

    The pause counts from the end of the turn's last row, as in the batch form; the turn's end is the latest one.
    The open turn of an episode is the state; it is put out when the next turn opens or the watermark on `at`
    passes its last row by a minute. Rows are taken in order of start and end, then of the column `order`, inside a
    micro-batch, whose rows of one episode are held together: the source's trigger options bound them.
    """

    ties = [order] if order else []

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cur = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            if cur:
                out.append((key[0], *cur[:4]))
            state.remove()
        else:
            # the rows of one episode in one micro-batch
            for pdf in [pd.concat(list(batches))]:
                for r in pdf.sort_values(["start_s", "end_s", *ties]).itertuples():
                    at = int(r.at_ms)
                    if cur and cur[0] == r.speaker and r.start_s - cur[4] <= gap_s:
                        cur = [cur[0], cur[1], max(cur[2], r.end_s), cur[3] + 1, r.end_s, max(cur[5], at)]
                    else:
                        if cur:
                            out.append((key[0], *cur[:4]))
                        cur = [r.speaker, r.start_s, r.end_s, 1, r.end_s, at]
            if cur:
                state.update(tuple(cur))
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), cur[5]) + 60_000)
        yield pd.DataFrame(out, columns=["ep", "speaker", "start_s", "end_s", "n_rows"])

    return (
        rows.select("ep", "at", F.unix_millis("at").alias("at_ms"), "start_s", "end_s", "speaker", *ties)
        .withWatermark("at", "1 minute")
        .groupBy("ep")
        .applyInPandasWithState(step, TURN, "speaker string, start_s double, end_s double, n_rows bigint, last_s double, at_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )
