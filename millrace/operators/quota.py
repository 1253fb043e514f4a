"""Quota accounting: tumbling minute and day windows with greedy admission; rejected requests use nothing up."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import replace
from datetime import timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import Quota


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def seconds_to_next_minute(ts: Column) -> Column:
    return F.greatest(F.lit(1), F.lit(60) - F.second(ts)).cast("int")


def seconds_to_day_end(ts: Column) -> Column:
    passed = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.greatest(F.lit(1), F.lit(86400) - passed).cast("int")


def by_requests(requests: DataFrame, rpm: int, key: str | None = None, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds allowed: the first ``rpm`` requests of each minute (and key). Minutes are the partitions, so the work spreads."""
    keys = [*([key] if key else []), "minute"]
    rows = requests.withColumn("minute", minute_of(F.col("ts")))
    return rows.withColumn("allowed", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= rpm).drop("minute")


def by_requests_and_day(requests: DataFrame, rpm: int, rpd: int, key: str | None = None, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds allowed: of the requests that their minute admits, the first ``rpd`` of each day.

    A day's rank is the rank inside the minute plus the admitted requests of the day's earlier minutes, which are summed
    over one row for each minute; no window holds a whole day's requests.
    """
    own = [key] if key else []
    rows = requests.withColumns({"minute": minute_of(F.col("ts")), "day": day_of(F.col("ts"))})
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*own, "minute").orderBy(*order)))
    minutes = rows.where(F.col("place") <= rpm).groupBy(*own, "day", "minute").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*own, "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = minutes.select(*own, "minute", before.alias("before"))
    joined = rows.join(minutes, [*own, "minute"], "left")
    return joined.withColumn("allowed", (F.col("place") <= rpm) & (F.col("place") + F.col("before") <= rpd)).drop("minute", "day", "place", "before")


class Meter:
    """The greedy fold itself, for one key."""

    def __init__(self, quota: Quota, minute=None, requests: int = 0, tokens: int = 0, day=None, of_day: int = 0):
        self.quota, self.minute, self.requests, self.tokens, self.day, self.of_day = quota, minute, requests, tokens, day, of_day

    def refusal(self, minute, day, tokens: int, consume: bool = True) -> str | None:
        """The minute's requests, then its tokens, then the day's requests; None admits."""
        if minute != self.minute:
            self.minute, self.requests, self.tokens = minute, 0, 0
        if day != self.day:
            self.day, self.of_day = day, 0
        q, cost = self.quota, int(tokens) + self.quota.reserve
        if self.requests + 1 > q.rpm:
            return "rpm"
        if self.tokens + cost > q.tpm:
            return "tpm"
        if self.of_day + 1 > q.rpd:
            return "rpd"
        if consume:
            self.requests, self.tokens, self.of_day = self.requests + 1, self.tokens + cost, self.of_day + 1
        return None

    def check(self, ts, tokens: int, consume: bool = True) -> tuple[bool, str | None, int]:
        """(allowed, reason, seconds to wait)."""
        ts = pd.Timestamp(ts)
        minute = ts.floor("min")
        reason = self.refusal(minute, ts.strftime("%Y-%m-%d"), tokens, consume)
        if reason is None:
            return True, None, 0
        free = ts.normalize() + timedelta(days=1) if reason == "rpd" else minute + timedelta(minutes=1)
        return False, reason, max(1, -(-(free - ts) // timedelta(seconds=1)))


FOLD_SCHEMA = "event_id long, allowed boolean, reason string, retry_after int"


def fold(requests: DataFrame, quota: Quota, key: str | None = None) -> DataFrame:
    """allowed, reason and retry_after of every request (event_id, ts, tokens); requests without a time share one minute.

    The day limit can't change which requests a minute admits before that limit is used up, so minutes are folded
    twice: without it, to count what each admits, and with the count of the day's earlier minutes as the start. Sorted
    partitions stream through the fold; a task holds one Arrow batch, whatever a day or a minute holds.
    """
    own = [key] if key else []
    minutes = requests.select(*(F.col(k).cast("string").alias(k) for k in own), "event_id", "ts", "tokens", minute_of(F.col("ts")).alias("minute"))
    groups = [*own, "minute"]

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition(*groups).sortWithinPartitions(*groups, "ts", "event_id").select(*groups, "event_id", "ts", "tokens", *more)

    def numbers(frame: pd.DataFrame) -> list[tuple]:
        return list(zip(frame[key].tolist() if key else [None] * len(frame), frame["minute"].to_numpy().astype("int64").tolist(), frame["tokens"].tolist(), strict=True))

    no_day = replace(quota, rpd=sys.maxsize)

    def admitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, meter = None, None
        for frame in frames:
            rows, counts = numbers(frame), {}
            for i, (who, minute, tokens) in enumerate(rows):
                if (who, minute) != at:
                    at, meter = (who, minute), Meter(no_day)
                if meter.refusal(minute, minute, tokens) is None:
                    start, n = counts.get(at, (i, 0))
                    counts[at] = start, n + 1
            found = frame.iloc[[start for start, _ in counts.values()]]
            yield found[groups].assign(n=[n for _, n in counts.values()])

    def decided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, meter = None, None
        for frame in frames:
            reasons = []
            for (who, minute, tokens), before in zip(numbers(frame), frame["before"].tolist(), strict=True):
                if (who, minute) != at:
                    at, meter = (who, minute), Meter(quota, minute, day=minute, of_day=before)
                reasons.append(meter.refusal(minute, minute, tokens))
            reason = pd.Series(reasons, index=frame.index, dtype=object)
            free = (frame["minute"] + timedelta(minutes=1)).mask(reason == "rpd", frame["ts"].dt.normalize() + timedelta(days=1))
            wait = -((frame["ts"] - free) // timedelta(seconds=1))
            yield pd.DataFrame({"event_id": frame["event_id"], "allowed": reason.isna(), "reason": reason, "retry_after": wait.fillna(60).clip(lower=1).where(reason.notna(), 0).astype("int32")})

    kinds = {f.name: f.dataType for f in minutes.schema}
    schema = StructType([StructField(g, kinds[g]) for g in groups] + [StructField("n", LongType())])
    used = dealt(minutes).mapInPandas(admitted, schema).groupBy(*groups).agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*own, day_of(F.col("minute"))).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    before = used.select(*(F.col(g).alias(f"__{g}") for g in groups), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups))
    # a minute that admits nothing has no count and needs none: its requests fail the minute's own limits
    started = minutes.join(before, same, "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return dealt(started, "before").mapInPandas(decided, FOLD_SCHEMA)


def usage(admitted: DataFrame) -> DataFrame:
    """minute, n_requests, n_tokens of the admitted requests (ts, tokens, allowed)."""
    return admitted.where("allowed").groupBy(minute_of(F.col("ts")).alias("minute")).agg(F.count("*").alias("n_requests"), F.sum("tokens").alias("n_tokens"))


__all__ = ["FOLD_SCHEMA", "Meter", "by_requests", "by_requests_and_day", "fold", "usage"]
