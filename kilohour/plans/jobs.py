"""Whole jobs: ingest, detect and alert, backtest, train, predict."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilohour import contracts
from kilohour.operators import alerts, backtest, clean, ensemble, forecast, joins, metrics, models, weather
from kilohour.operators.features import FeatureSpec
from kilohour.operators.residuals import detect_residuals
from kilohour.operators.rules import Rules
from kilohour.operators.windows import reserve_final_evaluation, select_windows
from kilohour.session import cut_lineage
from kilohour.sources import pages, tables


@dataclass(frozen=True)
class IngestResult:
    retained: DataFrame
    quarantine: DataFrame
    report: DataFrame
    reconciliation: DataFrame


def ingest_measurements(
    spark: SparkSession, landed: str, table: str, *, start: str, end: str, ingested_at: Column, policy: str = "error",
    quarantine: str | None = None,
) -> IngestResult:
    """Landed pages to the stored hourly table, with report and reconciliation."""
    parsed = pages.parse_pages(pages.read_page_texts(spark, landed))
    records = pages.page_records(parsed)
    wide = cut_lineage(clean.prepare_measurements(records, ingested_at))
    kept, absent = clean.apply_missing_demand_policy(wide, policy)
    reconciled = clean.require_reconciled(clean.reconciliation(records, wide, kept, start, end))
    contracts.canonical_grid().enforce(kept)
    tables.upsert_table(spark, table, kept, contracts.GRID_KEY, ["ingestion_timestamp_utc"])
    if quarantine is not None and not absent.isEmpty():
        tables.write_quarantine(absent, quarantine, "missing_demand", end)
    return IngestResult(kept, absent, clean.quality_report(kept), reconciled)


def ingest_renewables(spark: SparkSession, landed: str, table: str, *, ingested_at: Column, quarantine: str | None = None) -> IngestResult:
    """Landed fuel pages to the stored renewable table."""
    records = pages.page_records(pages.parse_pages(pages.read_page_texts(spark, landed)))
    valid, bad = clean.split_renewables(records, ingested_at)
    contracts.renewable_generation().enforce(valid)
    tables.upsert_table(spark, table, valid, contracts.GRID_KEY, ["ingestion_timestamp_utc"])
    if quarantine is not None and not bad.isEmpty():
        tables.write_quarantine(bad, quarantine, "negative_generation", "renewables")
    report = clean.renewable_report(records, valid, bad)
    return IngestResult(valid, bad, report, report)


def ingest_weather(
    spark: SparkSession, location_rows: DataFrame, locations: DataFrame, location_table: str, region_table: str,
    grid: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Location rows to both weather tables; returns the quality report and the grid overlap."""
    contracts.location_weather().enforce(location_rows)
    regional = weather.regional_weather(location_rows, locations)
    key = ["region", "timestamp_utc", "weather_data_type"]
    stamp = ["ingestion_timestamp_utc"]
    tables.upsert_table(spark, location_table, location_rows, [*key, "location_name"], stamp)
    tables.upsert_table(spark, region_table, regional, key, stamp)
    overlap = joins.overlap_report(grid, regional) if grid is not None else None
    return weather.weather_report(location_rows, regional), overlap


def revalidate(spark: SparkSession, table: str) -> DataFrame:
    """Stored table checked against its contract and reported anew."""
    tables.check_table(spark, table)
    return clean.quality_report(contracts.canonical_grid().enforce(tables.read_table(spark, table)))


@dataclass(frozen=True)
class Detection:
    events: DataFrame
    alerts: alerts.AlertBatch


def detect_and_alert(
    targets: Mapping[str, DataFrame],
    *,
    start: Column,
    end: Column,
    weather_rows: DataFrame | None = None,
    renewables: DataFrame | None = None,
    forecasts: DataFrame | None = None,
    stored_alerts: DataFrame | None = None,
    stored_history: DataFrame | None = None,
    chunk_rows: int = 4096,
    extra: Callable[[str, DataFrame], DataFrame] | None = None,
) -> Detection:
    """Rules and residuals of every target over look-back rows, kept inside [start, end], combined.

    Events are materialised once: the ensemble, the alerts and every report read them.
    """
    parts = []
    for target, rows in targets.items():
        rules = Rules(target, end, chunk_rows=chunk_rows)
        parts.append(rules.detect(rows, weather=weather_rows, renewables=renewables))
        if forecasts is not None:
            parts.append(detect_residuals(rows, forecasts, target, end, chunk_rows=chunk_rows)[0])
            if weather_rows is not None:
                parts.append(rules.forecast_coverage(forecasts, weather_rows))
        if extra is not None:
            parts.append(extra(target, rows))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    inside = found.where(F.col("timestamp_utc").between(start, end))
    single = cut_lineage(inside.transform(ensemble.one_per_id))
    events = single.unionByName(ensemble.combine(single, end))
    return Detection(events, alerts.process_events(events, stored_alerts, stored_history))


@dataclass(frozen=True)
class RuleBacktest:
    """Scored rule detections on planted anomalies."""

    metrics: DataFrame
    per_type: DataFrame
    matches: DataFrame
    labels: DataFrame
    events: DataFrame


def backtest_rules(
    rows: DataFrame, target: str, *, start: Column, end: Column, now: Column, seed: int = 42, chunk_rows: int = 4096
) -> RuleBacktest:
    """Plant anomalies, detect them with the rules, score the detections."""
    kinds = backtest.KINDS_BY_TARGET.get(target, backtest.DEFAULT_KINDS)
    planted, labels = backtest.inject(rows, target, seed=seed, kinds=kinds, chunk_rows=chunk_rows)
    events = cut_lineage(Rules(target, now, chunk_rows=chunk_rows).detect(planted))
    labels = cut_lineage(labels)
    matches = backtest.match_labels(events, labels)
    scores = backtest.detection_metrics(events, matches, start, end)
    return RuleBacktest(scores, backtest.per_type_metrics(matches), matches, labels, events)


@dataclass(frozen=True)
class Training:
    leaderboard: DataFrame
    slices: DataFrame
    decisions: DataFrame
    model: models.FittedModel


def train(
    frame: DataFrame,
    features: FeatureSpec,
    settings: models.ModelSettings,
    *,
    horizon: int,
    windows: int,
    step_size: int,
    created_at: Column,
    threshold: float = 0.0,
    trials: int = 0,
) -> Training:
    """Baselines and the tree model over shared windows, ranking, gate and the final refit."""
    history = max(features.required_history, 168)
    chosen = cut_lineage(
        select_windows(frame, horizon=horizon, windows=windows, step_size=step_size, required_history=history)
    )
    if trials:
        older, _ = reserve_final_evaluation(frame, chosen)
        search = select_windows(older, horizon=horizon, windows=windows, step_size=step_size, required_history=history)
        start = chosen.agg(F.min("validation_start")).first()[0]
        candidates = models.draw_settings(settings, trials, settings.seed)
        settings = models.tune_model(
            frame, search, start, features, candidates, horizon=horizon, created_at=created_at
        ).winner
    base = forecast.require_complete(forecast.evaluate_baselines(frame, chosen, horizon=horizon))

    def fit(past: DataFrame) -> models.FittedModel:
        return models.fit_target_model(past, features, settings)

    made = models.evaluate_model(frame, chosen, fit, horizon=horizon, created_at=created_at)
    common = ["region", "validation_window", "forecast_step", "timestamp_utc", "model_name", "predicted_value", "actual_value"]
    rows = base.select(*common).unionByName(made.select(*common))
    overall = metrics.forecast_metrics(rows, ["model_name"])
    board = metrics.leaderboard(overall)
    gate = board.where(F.col("model_name") == settings.name)
    reference = board.where("model_name = 'seasonal_naive_24h'").select(F.col("wape").alias("reference_wape"))
    judged = gate.join(F.broadcast(reference), F.col("wape").isNotNull() | F.col("wape").isNull())  # one row each
    decisions = metrics.promotion_decisions(judged, reference="reference_wape", threshold=threshold)
    return Training(board, metrics.metric_slices(rows), decisions, fit(frame))


def predict(spark: SparkSession, model: models.FittedModel, history: DataFrame, table: str | None, *, horizon: int, created_at: Column) -> DataFrame:
    """Forecast from the end of the history, check the contract and store."""
    made = models.recursive_forecast(model, history, horizon=horizon, created_at=created_at).drop("clipped")
    rows = contracts.target_forecasts().enforce(cut_lineage(made))
    if table is not None:
        tables.upsert_table(spark, table, rows, contracts.FORECAST_KEY)
    return rows
