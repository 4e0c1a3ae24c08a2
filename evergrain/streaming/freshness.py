"""Freshness of records as keyed state: what was last observed of a key, kept across batches and given up after a while.

Observations may come late, twice and in any order: the newest one (of equal times the greatest digest) is what a key has, so the state
after a set of observations does not depend on their order. A key that nothing was heard of for ``ttl`` of event time expires and says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = "key string, state string, digest string, at timestamp, before string"


class Freshness(StatefulProcessor):
    """States of a key: new, changed (its digest differs from the one before), unchanged, late (older than what is known), expired."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "digest string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # of the batch only the newest observation matters; rows come in parts
        best, older = None, 0
        for part in rows:
            for digest, at in zip(part["digest"], part["at"], strict=True):
                own = (pd.Timestamp(at), digest or "")
                best, older = (own, older) if best is None or own > best else (best, older + 1)
        had = self.known.get() if self.known.exists() else None
        was = (pd.Timestamp(had[1]), had[0]) if had is not None else None
        if was is not None and best <= was:
            state, now = ("unchanged" if best == was else "late"), was
        else:
            state, now = ("new" if was is None else "changed" if best[1] != was[1] else "unchanged"), best
            self.known.update((now[1], now[0].to_pydatetime()))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(now[0].timestamp() * 1000) + self.ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "state": [state], "digest": [now[1]], "at": [now[0]], "before": [was[1] if was is not None else None]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        had = self.known.get() if self.known.exists() else None
        self.known.clear()
        if had is not None:
            yield pd.DataFrame({"key": [key[0]], "state": ["expired"], "digest": [None], "at": [pd.Timestamp(had[1])], "before": [had[0]]})

    def close(self) -> None:
        pass


def freshness(observations: DataFrame, late: str, ttl_ms: int) -> DataFrame:
    """STATES: a row per key and batch that heard of it, and one when it expires. observations: a stream (key, digest, at). ``late``:
    how far the watermark stays behind the newest observation. Needs the RocksDB state store (see ``configure``)."""
    marked = observations.select("key", "digest", "at").withWatermark("at", late)
    return marked.groupBy("key").transformWithStateInPandas(statefulProcessor=Freshness(ttl_ms), outputStructType=STATES, outputMode="Update", timeMode="EventTime")


def configure(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
