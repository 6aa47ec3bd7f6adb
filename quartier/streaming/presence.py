"""Who is present: users seen within a window, kept as a stream's state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: Fixed value: seconds after which a user who isn't seen again is gone.
WINDOW_SECONDS = 300
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastSeen(StatefulProcessor):
    """Of each user the last time seen, in milliseconds, and one timer, when the window behind it ends."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at = max((int(batch["ms"].max()) for batch in rows if len(batch)), default=None)
        before = self.last.get()[0] if self.last.exists() else None
        # late rows, whose window has ended, and rows older than what is known change nothing
        if at is None or at + self.window_ms <= timerValues.getCurrentWatermarkInMs() or (before is not None and at <= before):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else int(timer.expiryTimestampMs))
        self.last.update((at,))
        self.handle.registerTimer(at + self.window_ms)
        yield pd.DataFrame({"user": [key[0]], "last_ms": [at], "present": [True]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0] if self.last.exists() else None
        # a timer of an earlier row of this batch may still fire
        if at is None or at + self.window_ms > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.last.clear()
        yield pd.DataFrame({"user": [key[0]], "last_ms": [at], "present": [False]})

    def close(self) -> None:
        pass


def presence(events: DataFrame, user: str, at: str, late: str = "1 minute", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """A stream of changes (user, last, present): a row when a user is seen later than before, and one when the window behind the last time has passed by event time.

    State holds one time for each present user and nothing for those who have gone. Rows later than the watermark allows are left out if their window has ended; null
    users and times are left out. Start queries with `ready`'s settings.
    """
    kind = events.schema[user].dataType.simpleString()
    own = events.select(F.col(user).alias("user"), F.col(at).cast("timestamp").alias("__at")).filter("user IS NOT NULL AND __at IS NOT NULL")
    keyed = own.withWatermark("__at", late).select("user", "__at", F.unix_millis("__at").alias("ms")).groupBy("user")
    out = keyed.transformWithStateInPandas(_LastSeen(seconds * 1000), f"user {kind}, last_ms bigint, present boolean", "Update", "EventTime")
    return out.select("user", F.timestamp_millis("last_ms").alias("last"), "present")


def ready(spark: SparkSession) -> None:
    """Sets the session's state store to one that keeps timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
