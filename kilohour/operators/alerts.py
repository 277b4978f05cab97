"""Alerts: deduplication of events, status changes and automatic resolution, as set operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohour.contracts import ALERT_COLUMNS, ALERT_STATUSES, HISTORY_COLUMNS
from kilohour.errors import ContractViolation, NotFound
from kilohour.functions.ordered import walk
from kilohour.functions.scoring import severity_of_rank, severity_rank
from kilohour.functions.text import alert_id, alert_title, short_sha
from kilohour.functions.time import iso_z
from kilohour.operators.events import one_per_id
from kilohour.session import cut_lineage

KEY = ["region", "target", "anomaly_type"]
# Status changes the user interface offers; the lifecycle itself accepts any.
OFFERED_TRANSITIONS = {
    "open": ("acknowledged", "resolved", "suppressed"),
    "acknowledged": ("resolved", "suppressed", "open"),
    "suppressed": ("open", "resolved"),
    "resolved": ("open",),
}
DEFAULT_REASON = {"acknowledged": "acknowledged", "resolved": "resolved", "suppressed": "suppressed", "open": "reopened"}
STATE = (
    "status", "severity", "first_seen_utc", "last_seen_utc", "occurrence_count", "latest_anomaly_id", "title", "summary",
    "acknowledged_at_utc", "resolved_at_utc", "metadata_json",
)


@dataclass(frozen=True)
class AlertBatch:
    """Changed alerts, new history rows and the events with what happened to them."""

    alerts: DataFrame
    history: DataFrame
    outcomes: DataFrame


def state_fingerprint(field) -> Column:
    """Hash of the business state; ``field`` maps a column name to a Column. Update time is left out."""
    parts = []
    for name in sorted(STATE):
        value = field(name)
        if name.endswith("_utc"):
            value = iso_z(value)
        elif name == "occurrence_count":
            value = F.coalesce(value.cast("long"), F.lit(0))
        parts.append(value.alias(name))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def process_events(
    events: DataFrame,
    alerts: DataFrame | None = None,
    history: DataFrame | None = None,
    *,
    dedup_hours: int = 6,
    chunk_hours: int = 4096,
) -> AlertBatch:
    """Open, extend or reopen alerts for a batch of events.

    An open alert takes part in its key's time order as a row at its last sighting. An event
    continues whatever stands before it if that is at most ``dedup_hours`` old, so alerts are the
    islands of that order. Events already in the history change nothing.
    """
    unique = one_per_id(events)
    if history is not None:
        seen = history.select("anomaly_id").where("anomaly_id IS NOT NULL").distinct()
        fresh, known = unique.join(seen, "anomaly_id", "left_anti"), unique.join(seen, "anomaly_id", "left_semi")
    else:
        fresh, known = unique, None
    marked = _sequence(fresh, alerts)
    window_us = dedup_hours * 3_600_000_000

    def breaks(prev, cur):
        gap = F.unix_micros(cur("_at")) - F.unix_micros(prev("_at"))
        return (cur("_kind") == 0) | (gap > window_us)

    # alerts, history and outcomes all read the linked events and their islands
    linked = cut_lineage(walk(
        marked, keys=KEY, order=["_at", "_kind", "detector_name", "anomaly_id"],
        chunk=F.floor(F.unix_micros("_at") / F.lit(chunk_hours * 3_600_000_000)),
        carry=["explanation"], breaks=breaks, row="_n",
    ))
    islands = cut_lineage(_islands(linked, alerts))
    changed = _changed_alerts(islands)
    steps = _steps(linked, islands)
    outcomes = steps.select("anomaly_id", "alert_id", F.col("_action").alias("outcome"))
    if known is not None:
        outcomes = outcomes.unionByName(
            known.select("anomaly_id", F.lit(None).cast("string").alias("alert_id"), F.lit("unchanged").alias("outcome"))
        )
    return AlertBatch(changed, _history_rows(steps), outcomes)


_BASE = tuple(c for c in ALERT_COLUMNS if c not in KEY)


def _sequence(fresh: DataFrame, alerts: DataFrame | None) -> DataFrame:
    """Events (kind 1) and active alerts at their last sighting (kind 0) in one frame."""
    rows = fresh.select(
        *KEY,
        F.col("timestamp_utc").alias("_at"),
        F.lit(1).alias("_kind"),
        "detector_name",
        "anomaly_id",
        "explanation",
        severity_rank(F.col("severity")).alias("_rank"),
        "detected_at_utc",
    )
    if alerts is None:
        return rows.withColumn("_base", F.lit(None).cast(_base_type()))
    active = alerts.where(F.col("status").isin("open", "acknowledged")).select(
        *KEY,
        F.col("last_seen_utc").alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit("").alias("detector_name"),
        F.col("alert_id").alias("anomaly_id"),
        F.col("summary").alias("explanation"),
        severity_rank(F.col("severity")).alias("_rank"),
        F.col("updated_at_utc").alias("detected_at_utc"),
        F.struct(*_BASE).cast(_base_type()).alias("_base"),
    )
    return rows.withColumn("_base", F.lit(None).cast(_base_type())).unionByName(active)


def _base_type() -> str:
    kinds = {"occurrence_count": "bigint"}
    fields = [f"{c}:{kinds.get(c, 'timestamp' if c.endswith('_utc') else 'string')}" for c in _BASE]
    return f"struct<{','.join(fields)}>"


def _islands(linked: DataFrame, alerts: DataFrame | None) -> DataFrame:
    """One row per alert touched: its state before the batch and what the batch adds."""
    is_event = F.col("_kind") == 1
    ev = F.struct("_at", "anomaly_id", "explanation", "_rank", "detected_at_utc", "detector_name")
    number = F.when(is_event, F.col("_n"))
    grouped = linked.groupBy(*KEY, "_island").agg(
        F.count_if(is_event).alias("_events"),
        F.max("_base").alias("_base"),
        F.min_by(ev, number).alias("_first"),
        F.max_by(ev, number).alias("_last"),
        F.min(number).alias("_first_n"),
        F.max(F.when(is_event, F.col("_rank"))).alias("_top"),
        F.min(F.when(is_event & (F.col("_rank") >= 1), F.col("_n"))).alias("_warning_n"),
        F.min(F.when(is_event & (F.col("_rank") >= 2), F.col("_n"))).alias("_critical_n"),
    )
    named = grouped.where("_events > 0").withColumn(
        "alert_id",
        F.coalesce(
            F.col("_base.alert_id"),
            alert_id(F.col("region"), F.col("target"), F.col("anomaly_type"), F.col("_first._at")),
        ),
    )
    if alerts is None:
        return named.withColumn("_earlier", F.lit(None).cast(_base_type()))
    # A new alert may carry the id of a closed one: it is then reopened, not opened.
    earlier = alerts.select("alert_id", F.struct(*_BASE).cast(_base_type()).alias("_earlier"))
    return named.join(earlier, "alert_id", "left")


def without_state(rows: DataFrame) -> DataFrame:
    """Rows of alerts that were not stored before, as ``state_after`` reads them."""
    return rows.withColumn("_base", F.lit(None).cast(_base_type()))


def _base_rank() -> Column:
    return F.when(F.col("_base").isNull(), -1).otherwise(severity_rank(F.col("_base.severity")))


def state_after(rank: Column, at: Column, count: Column, latest: Column, summary: Column) -> dict[str, Column]:
    """Alert state once some of the island's events are in."""
    raised = rank > _base_rank()
    base = F.col("_base")
    severity = F.when(raised, severity_of_rank(rank)).otherwise(base["severity"])
    title = F.when(raised, alert_title(severity_of_rank(rank), F.col("anomaly_type"), F.col("region"))).otherwise(base["title"])
    return {
        "status": F.coalesce(base["status"], F.lit("open")),
        "severity": severity,
        "first_seen_utc": F.coalesce(base["first_seen_utc"], F.col("_first._at")),
        "last_seen_utc": at,
        "occurrence_count": (F.coalesce(base["occurrence_count"], F.lit(0)) + count).cast("long"),
        "latest_anomaly_id": latest,
        "title": title,
        "summary": summary,
        "acknowledged_at_utc": base["acknowledged_at_utc"],
        "resolved_at_utc": base["resolved_at_utc"],
        "metadata_json": F.coalesce(
            base["metadata_json"], F.to_json(F.struct(F.col("_first.detector_name").alias("detector")))
        ),
    }


def _changed_alerts(islands: DataFrame) -> DataFrame:
    last = F.col("_last")
    state = state_after(F.col("_top"), last["_at"], F.col("_events"), last["anomaly_id"], last["explanation"])
    rows = islands.select(
        "alert_id", *KEY, *[c.alias(n) for n, c in state.items()],
        F.coalesce(F.col("_base.created_at_utc"), F.col("_first.detected_at_utc")).alias("created_at_utc"),
        last["detected_at_utc"].alias("updated_at_utc"),
    )
    return rows.select(*ALERT_COLUMNS)


def _steps(linked: DataFrame, islands: DataFrame) -> DataFrame:
    """Each event with the state of its alert before and after it."""
    events = linked.where("_kind = 1").select(
        *KEY, "_island", "_n", "_at", "anomaly_id", "explanation", "detected_at_utc",
        F.col("_prev._at").alias("_prev_at"), F.col("_prev.anomaly_id").alias("_prev_id"),
        F.col("_prev.explanation").alias("_prev_text"),
    )
    wanted = ["_base", "_earlier", "_first", "_first_n", "_warning_n", "_critical_n", "alert_id"]
    rows = events.join(islands.select(*KEY, "_island", *wanted), [*KEY, "_island"])
    place = F.col("_n") - F.col("_first_n") + 1

    def rank_at(n: Column) -> Column:
        reached = F.when(n >= F.col("_critical_n"), 2).when(n >= F.col("_warning_n"), 1).otherwise(0)
        return F.greatest(reached, _base_rank())

    after = state_after(rank_at(F.col("_n")), F.col("_at"), place, F.col("anomaly_id"), F.col("explanation"))
    before = state_after(
        rank_at(F.col("_n") - 1), F.col("_prev_at"), place - 1, F.col("_prev_id"), F.col("_prev_text")
    )
    is_first = place == 1
    stored = F.coalesce(F.col("_base"), F.col("_earlier"))
    stored_print = F.when(stored.isNull(), "none").otherwise(state_fingerprint(lambda n: stored[n]))
    opened = is_first & F.col("_base").isNull()
    action = (
        F.when(opened & F.col("_earlier").isNotNull(), "reopened").when(opened, "opened").otherwise("occurrence")
    )
    return rows.withColumns(
        {
            "_action": action,
            "_before_print": F.when(is_first, stored_print).otherwise(state_fingerprint(lambda n: before[n])),
            "_after_print": state_fingerprint(lambda n: after[n]),
            "status": after["status"],
            "severity": after["severity"],
        }
    )


def _history_rows(steps: DataFrame) -> DataFrame:
    return steps.select(
        short_sha(F.col("alert_id"), F.col("_action"), F.col("_before_print"), F.col("_after_print")).alias("history_id"),
        "alert_id",
        "status",
        "severity",
        F.col("detected_at_utc").alias("changed_at_utc"),
        F.col("_action").alias("change_reason"),
        "anomaly_id",
        F.to_json(
            F.struct(
                F.col("_after_print").alias("new_state_fingerprint"),
                F.col("_before_print").alias("previous_state_fingerprint"),
            )
        ).alias("metadata_json"),
    ).select(*HISTORY_COLUMNS)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """opened, updated and unchanged events of a batch."""
    kind = F.col("outcome")
    return outcomes.agg(
        F.count_if(kind == "opened").alias("opened"),
        F.count_if(kind.isin("reopened", "occurrence")).alias("updated"),
        F.count_if(kind == "unchanged").alias("unchanged"),
    )


def change_status(alerts: DataFrame, transitions: DataFrame, *, only_offered: bool = False) -> AlertBatch:
    """Apply (alert_id, new_status, at[, reason]) rows; a status an alert already has is no change.

    The allowed-transition table is enforced only on request.
    """
    if "reason" not in transitions.columns:
        transitions = transitions.withColumn("reason", F.lit(None).cast("string"))
    bad = transitions.where(~F.col("new_status").isin(*ALERT_STATUSES)).limit(1).collect()
    if bad:
        raise ContractViolation(f"unsupported alert status {bad[0]['new_status']}")
    absent = transitions.join(alerts.select("alert_id"), "alert_id", "left_anti").limit(1).collect()
    if absent:
        raise NotFound(f"alert {absent[0]['alert_id']} was not found")
    joined = alerts.join(transitions, "alert_id").where(F.col("status") != F.col("new_status"))
    if only_offered:
        allowed = F.lit(False)
        for source, targets in OFFERED_TRANSITIONS.items():
            allowed = allowed | ((F.col("status") == source) & F.col("new_status").isin(*targets))
        joined = joined.where(allowed)
    new = F.col("new_status")
    after = {name: F.col(name) for name in STATE}
    after["status"] = new
    after["acknowledged_at_utc"] = F.when(new == "acknowledged", F.col("at")).otherwise(F.col("acknowledged_at_utc"))
    after["resolved_at_utc"] = F.when(new == "resolved", F.col("at")).when(new != "open", F.col("resolved_at_utc"))
    reasons = F.create_map(*[F.lit(x) for item in DEFAULT_REASON.items() for x in item])
    steps = joined.withColumns(
        {
            "_action": F.coalesce("reason", reasons[new]),
            "_before_print": state_fingerprint(F.col),
            "_after_print": state_fingerprint(lambda n: after[n]),
            "_ack": after["acknowledged_at_utc"],
            "_res": after["resolved_at_utc"],
        }
    )
    changed = steps.select(
        *[
            {
                "status": new, "acknowledged_at_utc": F.col("_ack"), "resolved_at_utc": F.col("_res"),
                "updated_at_utc": F.col("at"),
            }.get(c, F.col(c)).alias(c)
            for c in ALERT_COLUMNS
        ]
    )
    rows = steps.withColumns(
        {"status": new, "anomaly_id": F.col("latest_anomaly_id"), "detected_at_utc": F.col("at")}
    )
    return AlertBatch(changed, _history_rows(rows), rows.select("anomaly_id", "alert_id", F.col("_action").alias("outcome")))


def auto_resolve(alerts: DataFrame, now: Column, *, hours: int = 24) -> AlertBatch:
    """Resolve open and acknowledged alerts unseen for ``hours`` or longer, all in one pass."""
    idle = F.unix_micros(now) - F.unix_micros("last_seen_utc") >= hours * 3_600_000_000
    due = alerts.where(F.col("status").isin("open", "acknowledged") & idle)
    transitions = due.select(
        "alert_id", F.lit("resolved").alias("new_status"), now.alias("at"), F.lit("auto_resolved").alias("reason")
    )
    return change_status(alerts, transitions)


def alert_detail(alerts: DataFrame, history: DataFrame) -> DataFrame:
    """Alerts with their ordered history; one alert's history is what is collected."""
    rows = history.groupBy("alert_id").agg(
        F.array_sort(F.collect_list(F.struct("changed_at_utc", "history_id", "change_reason", "status", "severity", "anomaly_id"))).alias("history")
    )
    return alerts.join(rows, "alert_id", "left")
