"""UTC timestamps: parsing, rendering, spines and age bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilohour.series import HOURLY, SeriesSpec


def to_utc(column: Column | str) -> Column:
    """Timestamp read as UTC (session zone is UTC); text with an offset is converted."""
    return F.to_timestamp(column)


def parse_period(column: Column | str, *, strict: bool = True) -> Column:
    """Timestamp from page text such as ``2024-01-01T00`` or any ISO form."""
    text = F.col(column) if isinstance(column, str) else column
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}$"), F.concat(text, F.lit(":00:00"))).otherwise(text)
    return full.cast("timestamp") if strict else full.try_cast("timestamp")


def iso_z(column: Column | str) -> Column:
    """ISO-8601 text with ``Z``; the fraction appears only when it is not zero."""
    stamp = F.col(column) if isinstance(column, str) else column
    micros = F.pmod(F.unix_micros(stamp), F.lit(1_000_000))
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == 0, F.concat(whole, F.lit("Z"))).otherwise(
        F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    )


def hourly_spine(spark: SparkSession, start: str, end: str, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Every hour from start to end; a date-only end means that whole day."""
    last = F.date_trunc("HOUR", F.lit(end).cast("timestamp"))
    if len(end.strip()) == 10:
        last = spec.shift(last, int(23 * 3600 / spec.step_seconds))
    first = F.date_trunc("HOUR", F.lit(start).cast("timestamp"))
    step = F.make_dt_interval(secs=F.lit(spec.step_seconds))
    return spark.range(1).select(F.explode(F.sequence(first, last, step)).alias(spec.time))


def data_age_band(observed: Column, now: Column) -> Column:
    """fresh up to 2 h, aging up to 24 h, else stale; unknown without a timestamp."""
    hours = (F.unix_micros(now) - F.unix_micros(observed)) / F.lit(3_600_000_000.0)
    return (
        F.when(observed.isNull(), "unknown").when(hours <= 2, "fresh").when(hours <= 24, "aging").otherwise("stale")
    )
