"""Quota accounting over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Quota
from ..operators.quota import FOLD_SCHEMA, Meter

STATE = "minute timestamp, requests long, tokens long, day string, of_day long"


def admit(requests: DataFrame, quota: Quota, key: str | None = None) -> DataFrame:
    """allowed, reason and retry_after of every request (event_id, ts, tokens) as it comes.

    Requests of one micro-batch are taken in order of time and id. ``key`` names the accounts; without one all requests
    share one meter, whose state is one row.
    """

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        meter = Meter(quota, *state.get) if state.exists else Meter(quota)
        frame = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        out = [(i, *meter.check(ts, n)) for i, ts, n in zip(frame["event_id"], frame["ts"], frame["tokens"], strict=True)]
        state.update((meter.minute, meter.requests, meter.tokens, meter.day, meter.of_day))
        yield pd.DataFrame(out, columns=["event_id", "allowed", "reason", "retry_after"])

    rows = requests.withColumn("account", F.col(key).cast("string") if key else F.lit("all"))
    return rows.groupBy("account").applyInPandasWithState(step, FOLD_SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
