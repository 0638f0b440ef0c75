"""Source health as a stateful stream that puts late events in their place.

Per domain the state holds the result of all events the watermark has passed, and, in a list, the events it has not:
those may still get company before them. A batch appends its events to the list and gives the domain's present health,
the result with the list applied in (time, id) order. A timer at the watermark moves what can no longer change from the
list to the result, so the list holds as many events as the lateness allows and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkfold.operators.health import BASE, after

HEALTH = "domain string, events bigint, failures bigint, backoff double"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HealthProcessor(StatefulProcessor):
    """State of one domain: ``settled`` (events, failures, back-off) and the ``open`` events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "events bigint, failures bigint, backoff double")
        self.open = handle.getListState("open", "at bigint, event_id bigint, ok boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for part in rows for x in zip(
            (part["at"]).tolist(), part["event_id"].tolist(), part["ok"].fillna(False).astype(bool).tolist(), strict=True)]
        if new:
            self.open.appendList(new)
            self.handle.registerTimer(max(at for at, _, _ in new) // 1000 + 1)
        yield self._present(key, sorted(self._open()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self._open())
        done = [e for e in events if e[0] < passed]
        if done:
            self.settled.update(self._applied(done))
            rest = events[len(done):]
            if rest:
                self.open.put(rest)
            else:
                self.open.clear()
        yield from ()

    def close(self) -> None:
        pass

    def _open(self) -> list[tuple]:
        return [tuple(e) for e in self.open.get()] if self.open.exists() else []

    def _applied(self, events: list[tuple]) -> tuple[int, int, float]:
        n, failures, backoff = tuple(self.settled.get()) if self.settled.exists() else (0, 0, BASE)
        for _, _, ok in events:
            failures, backoff = after(failures, backoff, ok)
        return n + len(events), failures, backoff

    def _present(self, key, events: list[tuple]) -> pd.DataFrame:
        n, failures, backoff = self._applied(events)
        return pd.DataFrame({"domain": [key[0]], "events": [n], "failures": [failures], "backoff": [backoff]})


def stream_health(fetch_log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The present health of every domain that a batch has events of. Events that are late by more than ``lateness``
    are dropped, as are events without domain or time."""
    events = (fetch_log.filter(F.col("domain").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", lateness)
              .select("domain", "ts", F.unix_micros("ts").alias("at"), "event_id", "ok"))
    return events.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=HealthProcessor(), outputStructType=HEALTH, outputMode="Update", timeMode="EventTime")


def run_source_health(fetch_log: DataFrame, out: str, checkpoint: str, lateness: str = "1 hour"):
    """Start the stream; every batch writes the domains it has changed to ``out/batch=N``."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    spark = fetch_log.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # the store that list states and timers need; a query keeps the one it starts with
    try:
        return (stream_health(fetch_log, lateness).writeStream.outputMode("update").foreachBatch(one_batch)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE, before)


def latest_health(spark: SparkSession, out: str) -> DataFrame:
    """The last row of every domain in the output of ``run_source_health``."""
    rows = spark.read.schema(f"{HEALTH}, batch bigint").option("basePath", out).parquet(out)
    last = rows.groupBy("domain").agg(F.max_by(F.struct("events", "failures", "backoff"), "batch").alias("s"))
    return last.select("domain", "s.events", "s.failures", "s.backoff")
