"""Raw measurement and fuel rows to validated hourly tables, with reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohour.contracts import CANONICAL_COLUMNS, MEASURES, RENEWABLE_COLUMNS
from kilohour.errors import ConflictingDuplicates, ContractViolation
from kilohour.functions.ordered import side_by_side
from kilohour.functions.time import hourly_spine, iso_z, parse_period
from kilohour.operators.continuity import gap_steps, previous_times
from kilohour.series import HOURLY, SeriesSpec

# Source codes and names of the four measurements and of the two fuels.
MEASUREMENT_CODES = {
    "D": "demand_mw", "DEMAND": "demand_mw",
    "DF": "forecast_demand_mw", "DEMAND FORECAST": "forecast_demand_mw",
    "NG": "net_generation_mw", "NET GENERATION": "net_generation_mw",
    "TI": "total_interchange_mw", "TOTAL INTERCHANGE": "total_interchange_mw",
}
FUEL_CODES = {
    "SUN": "solar_generation_mw", "SOLAR": "solar_generation_mw", "SOLAR GENERATION": "solar_generation_mw",
    "WND": "wind_generation_mw", "WIND": "wind_generation_mw", "WIND GENERATION": "wind_generation_mw",
}
FUELS = ("solar_generation_mw", "wind_generation_mw")


def _lookup(codes: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def measurement_rows(records: DataFrame) -> DataFrame:
    """(timestamp, region, measurement_type, value); the code wins over the name when it is known."""
    code = F.upper(F.trim("type"))
    name = F.upper(F.trim(F.coalesce("type_name", F.lit(""))))
    known = code.isin(*MEASUREMENT_CODES)
    kind = F.when(known, code).when(name != "", name).otherwise(F.col("type"))
    return records.select(
        F.col("period").alias("timestamp"),
        F.col("respondent").alias("region"),
        kind.alias("measurement_type"),
        F.col("value"),
    )


def mapped_measurements(rows: DataFrame, *, strict: bool = True) -> DataFrame:
    """Typed measurements with their canonical name; unknown kinds are left out.

    A bad time or number stops a strict read; a lenient one turns it into null.
    """
    number = F.col("value").cast("double") if strict else F.col("value").try_cast("double")
    return rows.select(
        "region",
        parse_period("timestamp", strict=strict).alias("timestamp_utc"),
        _lookup(MEASUREMENT_CODES, F.upper("measurement_type")).alias("measure"),
        F.nanvl(number, F.lit(None).cast("double")).alias("value"),
    ).where(F.col("measure").isNotNull())


def fuel_rows(records: DataFrame) -> DataFrame:
    """(region, timestamp_utc, measure, value) read leniently; rows lacking a key part are dropped."""
    code = F.upper(F.trim(F.coalesce("fueltype", "type", F.lit(""))))
    name = F.upper(F.trim(F.coalesce("type_name", F.lit(""))))
    measure = _lookup(FUEL_CODES, F.when(code.isin(*FUEL_CODES), code).otherwise(name))
    number = F.col("value").cast("string").try_cast("double")
    return records.select(
        F.col("respondent").alias("region"),
        parse_period("period", strict=False).alias("timestamp_utc"),
        measure.alias("measure"),
        F.nanvl(number, F.lit(None).cast("double")).alias("value"),
    ).dropna(subset=["timestamp_utc", "region", "measure"])


def conflicts(rows: DataFrame, keys: Sequence[str] = ("region", "timestamp_utc", "measure")) -> DataFrame:
    """Keys with more than one value; a missing value counts as a value of its own.

    Minimum, maximum and counts decide it, so partial aggregation applies even to a hot key.
    """
    known, copies = F.count("value"), F.count(F.lit(1))
    different = (F.min("value") != F.max("value")) | ((known > 0) & (known < copies))
    return (
        rows.groupBy(*keys)
        .agg(different.alias("_differs"), copies.alias("copies"), F.min("value").alias("low"), F.max("value").alias("high"))
        .where(F.coalesce("_differs", F.lit(False)))
        .drop("_differs")
    )


def require_no_conflicts(rows: DataFrame) -> DataFrame:
    examples = conflicts(rows).limit(5).collect()
    if examples:
        raise ConflictingDuplicates(f"conflicting values for {[tuple(r)[:3] for r in examples]}")
    return rows


def pivot_measures(rows: DataFrame, measures: Sequence[str], keys: Sequence[str] = ("region", "timestamp_utc")) -> DataFrame:
    """One column per measure, always all of them; needs rows free of conflicts."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in measures])


def prepare_measurements(records: DataFrame, ingested_at: Column) -> DataFrame:
    """Records to the canonical hourly table, before the missing-demand policy."""
    rows = require_no_conflicts(mapped_measurements(measurement_rows(records)))
    wide = pivot_measures(rows, MEASURES).withColumn("ingestion_timestamp_utc", ingested_at)
    return wide.select(*CANONICAL_COLUMNS)


def apply_missing_demand_policy(wide: DataFrame, policy: str = "error") -> tuple[DataFrame, DataFrame]:
    """Retained rows and the rows to quarantine."""
    if policy not in ("error", "drop"):
        raise ValueError("policy must be 'error' or 'drop'")
    absent = wide.where(F.col("demand_mw").isNull())
    if policy == "error":
        count = absent.count()
        if count:
            raise ContractViolation(f"{count} hourly rows lack demand")
    return wide.where(F.col("demand_mw").isNotNull()), absent


def quality_report(wide: DataFrame, measures: Sequence[str] = MEASURES, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Counts, range, duplicates, missing and negative values and gap hours in one row.

    Rows whose entity or time is null are counted like all others; they are part of no series and open no gap.
    """
    per_key = wide.groupBy(*spec.key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"_m_{c}") for c in measures],
        *[F.count_if(F.col(c) < 0).alias(f"_g_{c}") for c in measures],
    )
    gaps = previous_times(per_key.select(*spec.key), spec).agg(F.coalesce(F.sum(gap_steps(spec)), F.lit(0)).alias("timestamp_gap_count"))
    negatives = sum((F.col(f"_g_{c}") for c in measures), F.lit(0))
    named = F.forall(F.array(*[F.col(c).isNotNull() for c in spec.entity]), lambda x: x)
    totals = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.min(spec.time).alias("range_start"),
        F.max(spec.time).alias("range_end"),
        F.count_distinct(*spec.entity).alias("region_count"),
        F.sort_array(F.collect_set(F.when(named, F.concat_ws("|", *spec.entity)))).alias("regions"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.sum(negatives), F.lit(0)).alias("negative_value_count"),
        *[F.coalesce(F.sum(f"_m_{c}"), F.lit(0)).alias(f"missing_{c}") for c in measures],
    )
    totals = side_by_side(totals, gaps)
    shares = {
        f"missing_pct_{c}": F.coalesce(F.try_divide(F.col(f"missing_{c}") * 100.0, F.col("row_count")), F.lit(0.0))
        for c in measures
    }
    regular = (F.col("timestamp_gap_count") == 0) & (F.col("duplicate_count") == 0)
    return totals.withColumns({**shares, "expected_hourly_frequency": regular})


def reconciliation(records: DataFrame, pivoted: DataFrame, retained: DataFrame, start: str, end: str) -> DataFrame:
    """From raw rows to retained rows; ``unexplained_difference`` must be zero."""
    raw = measurement_rows(records)
    per_row = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_n"))
    counts = per_row.agg(F.sum("_n").alias("raw_measurement_rows"), F.count(F.lit(1)).alias("unique_source_records"))
    clash = conflicts(mapped_measurements(raw, strict=False)).agg(F.count(F.lit(1)).alias("conflicting_duplicates"))
    demand = F.col("demand_mw")
    bad = demand.isNotNull() & (F.isnan(demand) | (F.abs(demand) == float("inf")) | (demand < 0))
    wide = pivoted.agg(
        F.count(F.lit(1)).alias("materialized_pivoted_timestamp_rows"),
        F.count_if(demand.isNull()).alias("missing_demand_rows"),
        F.count_if(bad).alias("other_invalid_rows"),
    )
    kept = retained.agg(F.count(F.lit(1)).alias("retained_rows"))
    hours = hour_differences(pivoted, start, end).agg(
        F.count_if(F.col("side") != "unexpected").alias("expected_hourly_timestamps"),
        F.count_if(F.col("side") == "missing").alias("missing_source_timestamp_rows"),
        F.count_if(F.col("side") == "unexpected").alias("unexpected_timestamp_rows"),
    )
    row = side_by_side(counts, clash, wide, kept, hours)
    exact = F.col("raw_measurement_rows") - F.col("unique_source_records")
    return row.withColumns(
        {
            "exact_duplicates_removed": exact,
            "pivoted_timestamp_rows": F.col("materialized_pivoted_timestamp_rows") + exact,
            "unexplained_difference": F.col("materialized_pivoted_timestamp_rows") - F.col("missing_demand_rows")
            - F.col("other_invalid_rows") - F.col("retained_rows"),
        }
    )


def hour_differences(observed: DataFrame, start: str, end: str, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Expected and observed hours with ``side``: both, missing or unexpected."""
    spine = hourly_spine(observed.sparkSession, start, end, spec).withColumn("_e", F.lit(1))
    seen = observed.select(spec.time).distinct().withColumn("_o", F.lit(1))
    side = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("both")
    return spine.join(seen, spec.time, "full").select(spec.time, side.alias("side"))


def require_reconciled(report: DataFrame) -> DataFrame:
    row = report.select("unexplained_difference", "conflicting_duplicates").first()
    if row["unexplained_difference"] or row["conflicting_duplicates"]:
        raise ContractViolation(f"reconciliation failed: {row.asDict()}")
    return report


def split_renewables(records: DataFrame, ingested_at: Column) -> tuple[DataFrame, DataFrame]:
    """Valid hourly solar and wind rows, and the rows with a negative value."""
    wide = pivot_measures(require_no_conflicts(fuel_rows(records)), FUELS)
    negative = F.coalesce(F.col(FUELS[0]) < 0, F.lit(False)) | F.coalesce(F.col(FUELS[1]) < 0, F.lit(False))
    valid = wide.where(~negative).withColumns(
        {
            "total_renewable_generation_mw": F.col(FUELS[0]) + F.col(FUELS[1]),
            "ingestion_timestamp_utc": ingested_at,
        }
    )
    return valid.select(*RENEWABLE_COLUMNS), wide.where(negative)


def renewable_report(records: DataFrame, valid: DataFrame, quarantine: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    linked = previous_times(valid, spec)
    kept = linked.agg(
        F.count(F.lit(1)).alias("retained_rows"),
        F.count_if(F.col("solar_generation_mw").isNull()).alias("missing_solar_rows"),
        F.count_if(F.col("wind_generation_mw").isNull()).alias("missing_wind_rows"),
        F.count_if(F.col("total_renewable_generation_mw").isNull()).alias("missing_total_rows"),
        F.coalesce(F.sum(gap_steps(spec)), F.lit(0)).alias("renewable_target_gap_count"),
    )
    raw = records.agg(F.count(F.lit(1)).alias("raw_measurement_rows"))
    bad = quarantine.agg(F.count(F.lit(1)).alias("quarantined_rows"))
    row = side_by_side(kept, raw, bad)
    return row.withColumn("hourly_rows", F.col("retained_rows") + F.col("quarantined_rows"))


def listing(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text with ``Z`` for export."""
    stamps = {f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    return df.select(*[iso_z(c).alias(c) if c in stamps else F.col(c) for c in df.columns])
