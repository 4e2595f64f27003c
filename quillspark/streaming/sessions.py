"""Extension: sessions over a stream, by event time, with late rows as an output of their own.

State of a key are its open sessions, merged as rows arrive in any order. A row counts as late if it is older than the
largest time seen (up to the batch before) by more than `delay`; late rows leave as rows of kind `late`, as long as they
are not older still by `grace`, beyond which the engine drops and counts them itself. A session is closed, and leaves
as a row of kind `session`, once no row that is not late can reach it any more; the engine's watermark wakes the key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, kind string, first long, last long, n long"  # times in microseconds
STATE = "sessions string"


def merged(open_: list[list[int]], at: int, gap: int) -> list[list[int]]:
    """Sessions [first, last, n] in order, with one more row: all that it connects become one."""
    near = [s for s in open_ if s[0] - gap < at < s[1] + gap]
    rest = [s for s in open_ if not s[0] - gap < at < s[1] + gap]
    one = [min([at, *(s[0] for s in near)]), max([at, *(s[1] for s in near)]), 1 + sum(s[2] for s in near)]
    return sorted([*rest, one])


def sessionized(events: DataFrame, gap_seconds: float, delay_seconds: float, grace_seconds: float) -> DataFrame:
    """events: a stream of (user_id, ts). Rows of OUTPUT: closed sessions and late rows."""
    gap, grace = int(gap_seconds * 1e6), int(grace_seconds * 1e6)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = json.loads(state.get[0]) if state.exists else []
        horizon = state.getCurrentWatermarkMs() * 1000 + grace  # what is older is late
        out = []
        for part in parts:
            for at in sorted(part["at"].tolist()):
                if at < horizon and state.getCurrentWatermarkMs() > 0:
                    out.append((key[0], "late", at, at, 1))
                else:
                    open_ = merged(open_, at, gap)
        if state.getCurrentWatermarkMs() > 0:
            out += [(key[0], "session", *s) for s in open_ if s[1] + gap <= horizon]
            open_ = [s for s in open_ if s[1] + gap > horizon]
        if open_:
            state.update((json.dumps(open_),))
            wake = max((open_[0][1] + gap - grace) // 1000 + 1, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(wake)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "kind", "first", "last", "n"])

    stream = events.select("user_id", "ts").withWatermark("ts", f"{delay_seconds + grace_seconds} seconds").withColumn("at", F.unix_micros("ts"))
    made = stream.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("user_id", "kind", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n")
