"""Alerts held as keyed stream state against the same events in one batch."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from kilohour.operators.alerts import auto_resolve, process_events
from kilohour.streaming.keyed import alert_steps, alerts_of, history_of, keyed_alert_stream

SCHEMA = (
    "region string, target string, anomaly_type string, timestamp_utc timestamp, detector_name string, anomaly_id string, "
    "anomaly_score double, severity string, explanation string, detected_at_utc timestamp"
)
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(seed=1, hours=120, n=260):
    """Events of three regions, a third of them in one key; ties in time, repeats and null texts included."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        region = "hot" if i % 3 == 0 else draw.choice(["a", "b"])
        kind = "demand_spike" if region == "hot" else draw.choice(["demand_spike", "flatline"])
        at = START + timedelta(hours=draw.randrange(hours))
        text = None if i % 20 == 0 else f"text {i}"
        rows.append((region, "demand_mw", kind, at, draw.choice(["rules", "residual"]), f"id{i}", float(i % 90),
                     draw.choice(["info", "warning", "critical"]), text, at + timedelta(minutes=5)))
    return sorted(rows, key=lambda r: (r[3], r[5]))


def stream(spark, folder, batches, **options):
    """The log after every batch of rows has been appended and read."""
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        keyed_alert_stream(spark, f"{folder}/events", schema, f"{folder}/log", f"{folder}/checkpoint", **options).awaitTermination()
    return spark.read.parquet(f"{folder}/log")


def expected(spark, rows, delay_hours=2):
    passed = max(r[3] for r in rows) - timedelta(hours=delay_hours)
    batch = process_events(spark.createDataFrame([r for r in rows if r[3] <= passed], SCHEMA))
    ended = auto_resolve(batch.alerts, F.lit(str(passed)).cast("timestamp"))
    return batch, {r["alert_id"] for r in ended.alerts.collect()}


def state(df, ended):
    names = [c for c in df.columns if c not in ("status", "resolved_at_utc", "updated_at_utc")]
    return {tuple(r[n] for n in names) for r in df.collect()}, {r["alert_id"] for r in df.collect() if r["status"] == "resolved"} | ended


def test_micro_batches_equal_one_batch(spark, tmp_path):
    rows = events()
    third = len(rows) // 3
    # repeats of known events and a batch boundary inside one hour change nothing
    parts = [rows[:third], rows[third - 5 : 2 * third], rows[2 * third :] + rows[-3:]]
    log = stream(spark, str(tmp_path), parts)
    batch, ended = expected(spark, rows)
    got, resolved = state(alerts_of(log), set())
    want, _ = state(batch.alerts, ended)
    assert got == want and resolved == ended and ended
    mine = {tuple(r) for r in history_of(log).where("change_reason <> 'auto_resolved'").drop("metadata_json").collect()}
    assert mine == {tuple(r) for r in batch.history.drop("metadata_json").collect()}
    idle = alerts_of(log).where("status = 'resolved'")
    assert idle.where("resolved_at_utc <> last_seen_utc + INTERVAL 24 HOURS").count() == 0
    ids = history_of(log)
    assert ids.count() == ids.select("history_id").distinct().count()


def test_disorder_within_the_delay(spark, tmp_path):
    """Events up to the delay late end where sorted ones do."""
    rows = events(seed=2, hours=60, n=90)
    mixed = sorted(rows, key=lambda r: (r[3] + timedelta(hours=random.Random(r[5]).randrange(6)), r[5]))
    log = stream(spark, str(tmp_path), [mixed[:30], mixed[30:60], mixed[60:]], delay="8 hours")
    batch, ended = expected(spark, rows, 8)
    assert state(alerts_of(log), set())[0] == state(batch.alerts, ended)[0]


def test_limits(spark, tmp_path):
    with pytest.raises(ValueError):
        alert_steps(spark.createDataFrame([], SCHEMA), dedup_hours=30, resolve_hours=24)
    assert alerts_of(stream(spark, str(tmp_path), [[]])).count() == 0
