"""Alert deduplication as keyed stream state: what a micro-batch costs follows its events, not the alerts stored so far.

Every (region, target, type) keeps the events that the watermark has not passed and its open alerts. When the watermark
passes events, they extend or open alerts in the order of time, detector and id, which is the order of
``alerts.process_events``, so the result does not depend on how files fall into micro-batches. Open alerts unseen for
``resolve_hours`` of event time are resolved by a timer and leave the state, which therefore holds, per key, the events
of one watermark delay and the alerts of the last ``resolve_hours``.

Output is a log of steps, appended and never rewritten; ``alerts_of`` and ``history_of`` read tables from it. A repeated
event adds nothing: within the delay its id is known, later the watermark drops it as late. Events that arrive later than the
delay are dropped by Spark, as the watermark says. Status changes by hand are applied to the tables, not to the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kilohour.contracts import ALERT_COLUMNS, HISTORY_COLUMNS
from kilohour.functions.scoring import severity_rank
from kilohour.functions.text import alert_id, short_sha
from kilohour.operators.alerts import KEY, state_after, state_fingerprint, without_state

HOUR_US = 3_600_000_000
EVENT = "at long, detector string, id string, score double, rank int, explanation string, detected long"
# open alert: first and last sighting, number of events, rank, last id and text, first detector and detection
ALERT = "first long, last long, n long, rank int, id string, explanation string, detector string, created long"
STEP = (
    "region string, target string, anomaly_type string, action string, at long, detected long, id string, explanation string, "
    "first long, created long, detector string, n long, rank int, prev_at long, prev_id string, prev_explanation string, prev_rank int"
)


def _schema(text: str) -> T.StructType:
    """A schema that workers can make too, where no session parses one."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in text.split(", "))])


EVENT_FIELDS = _schema(EVENT).names
STEP_FIELDS = _schema(STEP).names


class AlertState(StatefulProcessor):
    """State and timers of one (region, target, type)."""

    def __init__(self, dedup_hours: int, resolve_hours: int):
        self.window, self.idle = dedup_hours * HOUR_US, resolve_hours * HOUR_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _schema(EVENT))
        self.active = handle.getListState("active", _schema(ALERT))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            if len(frame):
                self.pending.appendList([_plain(r) for r in frame[EVENT_FIELDS].itertuples(index=False, name=None)])
                first = int(frame["at"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()]
        due, later = [], []
        for event in _one_per_id(waiting):
            (due if event[0] <= now else later).append(event)
        alerts = [list(a) for a in self.active.get()]
        steps = []
        for event in sorted(due):
            # alerts idle before this event are resolved before it, as their own timer would have done
            alerts = self._resolve(alerts, event[0], steps, key)
            steps.append(self._take(alerts, event, key))
        alerts = self._resolve(alerts, now, steps, key)
        self.pending.put(later) if later else self.pending.clear()
        self.active.put([tuple(a) for a in alerts]) if alerts else self.active.clear()
        moments = [e[0] for e in later] + [a[1] + self.idle for a in alerts]
        if moments:
            self._wake(min(moments))
        return iter([pd.DataFrame(steps, columns=STEP_FIELDS)] if steps else ())

    def _take(self, alerts: list, event: tuple, key: tuple) -> tuple:
        """The step of an event: it extends the newest alert if that is near enough, otherwise opens one."""
        at, detector, name, _, rank, text, detected = event
        if alerts and at - alerts[-1][1] <= self.window:
            alert = alerts[-1]
            before = (alert[1], alert[4], alert[5], alert[3])
            alert[1:6] = [at, alert[2] + 1, max(alert[3], rank), name, text]
            action = "occurrence"
        else:
            alert, before, action = [at, at, 1, rank, name, text, detector, detected], (None, None, None, None), "opened"
            alerts.append(alert)
        return (*key, action, at, detected, name, text, alert[0], alert[7], alert[6], alert[2], alert[3], *before)

    def _resolve(self, alerts: list, now: int, steps: list, key: tuple) -> list:
        kept = []
        for a in alerts:
            if now - a[1] < self.idle:
                kept.append(a)
            else:
                steps.append((*key, "auto_resolved", a[1], a[1] + self.idle, a[4], a[5], a[0], a[7], a[6], a[2], a[3], a[1], a[4], a[5], a[3]))
        return kept

    def _wake(self, moment: int) -> None:
        """One timer a key, at the earliest moment anything is due (rounded up to the watermark's milliseconds)."""
        wanted = -(-moment // 1000)
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= wanted:
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(wanted)

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    at, detector, name, score, rank, text, detected = row
    return (int(at), detector, name, float(score), int(rank), text, None if pd.isna(detected) else int(detected))


def _one_per_id(events: list) -> list:
    """The event of highest score per id, as in a batch."""
    best: dict = {}
    for event in events:
        known = best.get(event[2])
        if known is None or event[3] > known[3]:
            best[event[2]] = event
    return list(best.values())


def alert_steps(events: DataFrame, *, delay: str = "2 hours", dedup_hours: int = 6, resolve_hours: int = 24) -> DataFrame:
    """The log of steps of a stream of events (needs the RocksDB state store, see ``keyed_alert_stream``).

    ``resolve_hours`` must not be less than ``dedup_hours``: an alert that events may still extend is not idle.
    """
    if resolve_hours < dedup_hours:
        raise ValueError("resolve_hours must be at least dedup_hours")
    rows = events.withWatermark("timestamp_utc", delay).select(
        *KEY, "timestamp_utc", F.unix_micros("timestamp_utc").alias("at"), F.col("detector_name").alias("detector"),
        F.col("anomaly_id").alias("id"), F.col("anomaly_score").cast("double").alias("score"),
        severity_rank(F.col("severity")).cast("int").alias("rank"), "explanation", F.unix_micros("detected_at_utc").alias("detected"),
    )
    steps = rows.groupBy(*KEY).transformWithStateInPandas(AlertState(dedup_hours, resolve_hours), _schema(STEP), "append", "eventTime")
    return _named(steps)


def _moment(name: str) -> Column:
    return F.timestamp_micros(F.col(name))


def _named(steps: DataFrame) -> DataFrame:
    """Steps with alert ids, the state after each and the hashes of the states before and after."""
    rows = without_state(steps).withColumns({
        "alert_id": alert_id(F.col("region"), F.col("target"), F.col("anomaly_type"), _moment("first")),
        "_first": F.struct(_moment("first").alias("_at"), F.col("detector").alias("detector_name")),
    })
    ended = F.col("action") == "auto_resolved"
    after = state_after(F.col("rank"), _moment("at"), F.col("n"), F.col("id"), F.col("explanation"))
    open_state = dict(after)
    after["status"] = F.when(ended, "resolved").otherwise(after["status"])
    after["resolved_at_utc"] = F.when(ended, _moment("detected")).otherwise(after["resolved_at_utc"])
    before = state_after(F.col("prev_rank"), _moment("prev_at"), F.col("n") - 1, F.col("prev_id"), F.col("prev_explanation"))
    before = {n: F.when(ended, open_state[n]).otherwise(c) for n, c in before.items()}
    return rows.select(
        "alert_id", *KEY, *[c.alias(n) for n, c in after.items()],
        _moment("created").alias("created_at_utc"), _moment("detected").alias("updated_at_utc"),
        F.col("action").alias("change_reason"), F.col("n").alias("step"),
        F.when(F.col("action") == "opened", "none").otherwise(state_fingerprint(lambda n: before[n])).alias("before"),
        state_fingerprint(lambda n: after[n]).alias("after"),
    )


def alerts_of(steps: DataFrame) -> DataFrame:
    """The newest state of every alert in a stored log: partial aggregates, no order of the log needed."""
    newest = F.struct("step", F.col("status") == "resolved")
    return steps.groupBy("alert_id").agg(*[F.max_by(c, newest).alias(c) for c in ALERT_COLUMNS if c != "alert_id"]).select(*ALERT_COLUMNS)


def history_of(steps: DataFrame) -> DataFrame:
    """One history row per step, with the ids that a batch run gives to the same steps."""
    prints = F.to_json(F.struct(F.col("after").alias("new_state_fingerprint"), F.col("before").alias("previous_state_fingerprint")))
    return steps.select(
        short_sha(F.col("alert_id"), F.col("change_reason"), F.col("before"), F.col("after")).alias("history_id"), "alert_id", "status",
        "severity", F.col("updated_at_utc").alias("changed_at_utc"), "change_reason", F.col("latest_anomaly_id").alias("anomaly_id"),
        prints.alias("metadata_json"),
    ).select(*HISTORY_COLUMNS)


def keyed_alert_stream(spark: SparkSession, events_path: str, schema: T.StructType, log_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Process all new event files and stop; steps are appended to a Parquet folder exactly once."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    steps = alert_steps(spark.readStream.schema(schema).parquet(events_path), **options)
    writer = steps.writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
