"""Alert lifecycles as keyed state with timers.

The state of an alert is the first request of each kind that was seen.  It only
serves to send a row when one of them changes: the rows are merged by minimum in the
stored table (``runner.latest_versions`` with ``earliest``), so a state may be dropped at any time without
changing a status.  It is dropped when its timer runs out: ``idle`` after the last
request of an alert, or, for a resolved one, as soon as the watermark has passed
its resolution.  The state therefore grows with the alerts at work, not with all alerts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from vigilflow.streaming import jobs, runner

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ("ACKNOWLEDGED", "RESOLVED")
FIRSTS = "ack_at long, ack_id long, resolved_at long, resolved_id long"


class FirstRequests(StatefulProcessor):
    """Earliest (time, id) of each kind of request, per alert."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.firsts = handle.getValueState("firsts", FIRSTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.firsts.get()) if self.firsts.exists() else (None,) * 4
        best = {"ACKNOWLEDGED": known[:2], "RESOLVED": known[2:]}
        last = 0
        for batch in rows:
            for target, at, number in zip(batch["target"], batch["at"].tolist(), batch["request_id"].tolist()):
                if best[target][0] is None or (at, number) < best[target]:
                    best[target] = (at, number)
                last = max(last, at)
        now = tuple(best["ACKNOWLEDGED"]) + tuple(best["RESOLVED"])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a request before the resolution may come until the watermark has passed it
        final = best["RESOLVED"][0]
        self.handle.registerTimer(final // 1000 + 1 if final is not None else last // 1000 + self.idle_ms)
        if now != known:
            self.firsts.update(now)
            yield _row(key[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.firsts.clear()
        return iter(())

    def close(self) -> None:
        pass


def _row(alert, firsts) -> pd.DataFrame:
    columns = dict(zip(("ack_at", "ack_id", "resolved_at", "resolved_id"), firsts))
    return pd.DataFrame({"alert_id": [alert], **{c: pd.array([v], dtype="Int64") for c, v in columns.items()}})


def _first_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first request of each kind per alert, of every Arrow batch: an alert with a third of all requests sends few rows."""
    for batch in batches:
        yield batch.sort_values(["at", "request_id"], kind="stable").drop_duplicates(["alert_id", "target"])


def first_requests(requests: DataFrame, delay: str, idle_ms: int) -> DataFrame:
    """A stream of (alert_id, first request of each kind), a row whenever one of them changes.

    ``requests`` has alert_id, request_id, requested_at and target; other kinds, and rows without
    alert, id or time, are nothing.  Requests behind the watermark by more than
    ``delay`` may be left out.  Needs the RocksDB state store (``ROCKSDB``).
    """
    target = F.upper(F.trim("target"))
    # a time without zone is counted as UTC, whatever the session's zone
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(requested_at AS TIMESTAMP_NTZ))")
    rows = requests.select(F.col("alert_id").cast("long"), F.col("request_id").cast("long"), target.alias("target"), micros.alias("at"))
    rows = rows.filter(F.col("target").isin(*KINDS) & F.col("alert_id").isNotNull() & F.col("request_id").isNotNull() & F.col("at").isNotNull())
    few = rows.mapInPandas(_first_of_batch, rows.schema)
    timed = few.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", delay)
    return timed.groupBy("alert_id").transformWithStateInPandas(
        FirstRequests(idle_ms), outputStructType=f"alert_id long, {FIRSTS}", outputMode="Update", timeMode="EventTime"
    )


def earliest(rows: DataFrame) -> DataFrame:
    """Rows of one alert merged into its earliest requests."""
    ack, resolved = F.struct("ack_at", "ack_id"), F.struct("resolved_at", "resolved_id")
    best = rows.groupBy("alert_id").agg(
        F.min(F.when(F.col("ack_at").isNotNull(), ack)).alias("a"), F.min(F.when(F.col("resolved_at").isNotNull(), resolved)).alias("r"), F.max("batch").alias("batch")
    )
    return best.select("alert_id", "a.ack_at", "a.ack_id", "r.resolved_at", "r.resolved_id", "batch")


def places(firsts: DataFrame) -> DataFrame:
    """The merged rows as ``alert_id, ack, resolved``, each a (requested_at, request_id)."""

    def place(at: str, number: str):
        time = F.expr(f"timestampadd(MICROSECOND, {at}, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
        return F.when(F.col(at).isNotNull(), F.struct(time.alias("requested_at"), F.col(number).alias("request_id")))

    return firsts.select("alert_id", place("ack_at", "ack_id").alias("ack"), place("resolved_at", "resolved_id").alias("resolved"))


def alert_states(requests: DataFrame, alerts: DataFrame, delay: str = "10 minutes", idle_ms: int = 86_400_000, progress: list | None = None) -> DataFrame:
    """Runs the stream of ``requests`` to its end; status and times of every alert that had one, as ``jobs.alert_states``.

    ``progress`` gets the batches' progress, with the number of state rows.  The
    state store is chosen for this query alone; the session's setting is put back.
    """
    conf, name = requests.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    try:
        stored = runner.latest_versions(first_requests(requests, delay, idle_ms), ["alert_id"], "firsts", merge=earliest, progress=progress)
    finally:
        conf.set(name, before) if before else conf.unset(name)
    known = alerts.select(F.col("id").alias("alert_id"), F.upper("status").alias("initial"))
    return jobs.alert_status(places(stored).join(known, "alert_id"))
