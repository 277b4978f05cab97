"""Listings, summaries and reports over stored tables."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilohour.errors import NotFound
from kilohour.functions.ordered import side_by_side
from kilohour.series import HOURLY
from kilohour.session import shared_folder
from kilohour.sources.tables import filtered

SERIES = ["region", "target", "forecast_origin", "model_name", "model_version", "run_id", "weather_mode"]


def page(
    df: DataFrame, order: Sequence[Column | str], *, limit: int, offset: int = 0, equal: Mapping[str, object] | None = None
) -> tuple[DataFrame, DataFrame]:
    """One page of rows in a stable order, and the total before paging. End ``order`` with a unique id.

    Right for the first pages of a listing: offset and limit rows of every task are merged. Use a ``PageDirectory`` for deep pages.
    """
    rows = filtered(df, equal or {})
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    info = total.select(
        F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), "total",
        F.greatest(F.least(F.col("total") - offset, F.lit(limit)), F.lit(0)).alias("returned"),
        (F.col("total") > offset + limit).alias("has_more"),
    )
    return rows.orderBy(*order).offset(offset).limit(limit), info


# Most rows of one stored file of ranges, and most ranges in it.
FILE_ROWS, FILE_RANGES = 500_000, 64


@dataclass(frozen=True)
class PageDirectory:
    """A listing stored in ranges of its order, with the rows of each range: any page is read from the ranges it touches.

    ``_part`` numbers the stored files and ``_at`` the rows over all of them in the listing's order. Range ``i`` holds
    ``counts[i]`` rows from ``_at = firsts[i]`` on, all of them in one part.
    """

    path: str
    order: tuple[Column | str, ...]
    counts: tuple[int, ...]
    firsts: tuple[int, ...]

    @cached_property
    def starts(self) -> list[int]:
        """Rows before each range, and the total."""
        return [0, *accumulate(self.counts)]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def touched(self, limit: int, offset: int) -> tuple[list[int], int]:
        """Ranges that hold rows offset .. offset + limit - 1, and how many rows of the first one come before them."""
        low, high = max(offset, 0), min(offset + limit, self.total)
        if low >= high:
            return [], 0
        first, last = bisect_right(self.starts, low) - 1, bisect_left(self.starts, high)
        return [i for i in range(first, last) if self.counts[i]], offset - self.starts[first]

    def page(self, spark: SparkSession, *, limit: int, offset: int = 0) -> DataFrame:
        """Rows of one page in order; empty behind the end. Only the ranges it touches are read, by part and position."""
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        parts, skip = self.touched(limit, offset)
        low, high = (self.firsts[parts[0]], self.firsts[parts[-1]] + self.counts[parts[-1]]) if parts else (0, 0)
        files = sorted({self.firsts[i] >> 33 for i in parts})
        stored = spark.read.parquet(self.path).where(F.col("_part").isin(files) & (F.col("_at") >= low) & (F.col("_at") < high))
        return stored.drop("_part", "_at").orderBy(*self.order).offset(max(0, skip)).limit(limit if parts else 0)

    def info(self, spark: SparkSession, *, limit: int, offset: int = 0) -> DataFrame:
        """limit, offset, total, returned and has_more of a page, without reading rows."""
        total = self.total
        row = (limit, offset, total, max(0, min(total - offset, limit)), total > offset + limit)
        return spark.createDataFrame([row], "`limit` long, `offset` long, total long, returned long, has_more boolean")


def page_directory(
    df: DataFrame, order: Sequence[Column | str], *, rows_per_part: int = 1_000_000, equal: Mapping[str, object] | None = None
) -> PageDirectory:
    """Store a listing for deep paging. End ``order`` with a unique id; rows that tie in all of it may swap pages.

    One range sort cuts the rows into files of several ranges; borders come from a sample, the directory from counts, so
    uneven files cost reading, not correctness. Rows with equal order values share a file. The rows of a file are numbered
    in order and cut into even ranges of ``rows_per_part`` rows at most. So the tasks, and what they tell the driver,
    follow the files, not the ranges; the driver holds two numbers a range.
    """
    if {"_part", "_at"} & set(df.columns):
        raise ValueError("a listed column may not be named _part or _at")
    rows = filtered(df, equal or {})
    total = rows.count()
    files = max(1, -(-total // (rows_per_part * max(1, min(FILE_RANGES, FILE_ROWS // rows_per_part)))))
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/pages-{uuid4().hex}"
    ranged = rows.repartitionByRange(files, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *order)
    # the id is the partition's number shifted by 33 bits plus the row's place in it
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.partitionBy("_part").parquet(path)
    if not total:
        empty = rows.withColumns({"_part": F.lit(0), "_at": F.lit(0).cast("long")})
        empty.write.mode("overwrite").parquet(path)
    sizes = df.sparkSession.read.parquet(path).groupBy("_part").count().collect()
    firsts, counts = [], []
    for part, n in sorted((r["_part"], r["count"]) for r in sizes):
        ranges = -(-n // rows_per_part)
        cuts = [n * i // ranges for i in range(ranges + 1)]
        firsts += [(part << 33) + cut for cut in cuts[:-1]]
        counts += [b - a for a, b in zip(cuts, cuts[1:])]
    return PageDirectory(path, tuple(order), tuple(counts), tuple(firsts))


def complete_horizons(forecasts: DataFrame, horizon: int) -> DataFrame:
    """Series whose first ``horizon`` rows are exactly origin+1 .. origin+horizon.

    A series is one forecast horizon, so its window is short.
    """
    order = Window.partitionBy(*SERIES).orderBy("timestamp_utc")
    numbered = forecasts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= horizon)
    right = F.col("timestamp_utc") == HOURLY.shift("forecast_origin", F.col("_n"))
    return (
        numbered.groupBy(*SERIES)
        .agg(F.count(F.lit(1)).alias("_rows"), F.bool_and(right).alias("_exact"))
        .where((F.col("_rows") == horizon) & F.col("_exact"))
        .select(*SERIES)
    )


def latest_horizons(forecasts: DataFrame, horizon: int) -> DataFrame:
    """Rows of the newest complete series of every (region, target); gapped newer ones are skipped."""
    series = complete_horizons(forecasts, horizon)
    rest = [c for c in SERIES if c not in ("region", "target")]
    best = series.groupBy("region", "target").agg(F.max(F.struct(*rest)).alias("_b")).select("region", "target", "_b.*")
    rows = forecasts.join(best, SERIES, "left_semi")
    order = Window.partitionBy(*SERIES).orderBy("timestamp_utc")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= horizon).drop("_n")


def latest_forecast(forecasts: DataFrame, *, region: str, target: str, horizon: int) -> DataFrame:
    """The newest complete horizon of one region and target, or an error."""
    rows = latest_horizons(forecasts.where((F.col("region") == region) & (F.col("target") == target)), horizon)
    if rows.isEmpty():
        raise NotFound("no complete contiguous forecast horizon")
    return rows


def forecast_of_origin(forecasts: DataFrame, origin: Column, horizon: int) -> DataFrame:
    """First ``horizon`` rows of one origin in time order."""
    return forecasts.where(F.col("forecast_origin") == origin).orderBy("timestamp_utc", "model_name").limit(horizon)


def horizon_cards(forecasts: DataFrame, horizon: int) -> DataFrame:
    """Completeness, first, mean and largest value of each series."""
    return forecasts.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("points"),
        ((F.count(F.lit(1)) == horizon) & (F.count_distinct("timestamp_utc") == horizon)).alias("complete"),
        F.min_by("predicted_value", "timestamp_utc").alias("first_value"),
        F.avg("predicted_value").alias("mean_value"),
        F.max("predicted_value").alias("max_value"),
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """Rows, range, newest origin and model versions per region and target."""
    return forecasts.groupBy("region", "target").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp_utc").alias("start_time"),
        F.max("timestamp_utc").alias("end_time"),
        F.max("forecast_origin").alias("latest_forecast_origin"),
        F.array_sort(F.collect_set("model_version")).alias("model_versions"),
    )


def inspect_table(df: DataFrame, value: str = "demand_mw", time: str = "timestamp_utc", entity: str = "region") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        F.count_if(F.col(value).isNull()).alias("missing_values"),
        F.array_sort(F.collect_set(entity)).alias("entities"),
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-blank values."""
    text = F.col(column).cast("string")
    return df.where(text.isNotNull() & (text != "")).select(text.alias("value")).distinct().orderBy("value")


def daily_counts(events: DataFrame, time: str = "timestamp_utc") -> DataFrame:
    return events.groupBy(F.date_trunc("DAY", time).alias("day")).agg(F.count(F.lit(1)).alias("n"))


_DAILY = ["target", "detector_name", "anomaly_type", "severity"]


def anomaly_rates(events: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Events per target, detector, type, severity and day, per evaluated row of the target.

    ``evaluated`` holds (target, evaluated_rows); targets it lacks use the sum over all targets.
    """
    grouped = events.groupBy(*_DAILY, F.date_format("timestamp_utc", "yyyy-MM-dd").alias("day_utc")).agg(
        F.count(F.lit(1)).alias("event_count")
    )
    everything = evaluated.agg(F.sum("evaluated_rows").alias("_all"))  # one row
    rows = grouped.join(evaluated, "target", "left").join(F.broadcast(everything), F.col("day_utc").isNotNull())
    count = F.coalesce("evaluated_rows", "_all")
    return rows.withColumn("evaluated_rows", count).drop("_all").withColumn(
        "anomaly_rate", F.try_divide("event_count", "evaluated_rows")
    )


def anomaly_summary(events: DataFrame) -> DataFrame:
    """Daily groups with the rate per hourly opportunity."""
    return events.groupBy(*_DAILY, F.to_date("timestamp_utc").alias("day")).agg(
        F.count(F.lit(1)).alias("event_count"), (F.count(F.lit(1)) / 24.0).alias("hourly_opportunity_rate")
    )


def calibration_warnings(summary: DataFrame, maximum_rate: float = 0.10) -> DataFrame:
    """Days above the allowed rate; an empty summary calls for a review as well."""
    state = summary.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("hourly_opportunity_rate") > maximum_rate).alias("over")
    )
    text = (
        F.when(F.col("groups") == 0, "There is no detection to judge the thresholds by.")
        .when(F.col("over") > 0, "On some days more hours are flagged than the thresholds should allow.")
    )
    return state.select("groups", "over", text.alias("warning"))


def detector_agreement(events: DataFrame) -> DataFrame:
    """Instants with any detection, and those where more than one detector agrees."""
    per_instant = events.groupBy("region", "target", "timestamp_utc").agg(
        (F.min("detector_name") != F.max("detector_name")).alias("agreed")
    )
    left = per_instant.agg(F.count(F.lit(1)).alias("timestamp_groups"), F.count_if("agreed").alias("agreed_groups"))
    return side_by_side(left, events.agg(F.count_distinct("detector_name").alias("distinct_detectors")))


def effective_rate(events: DataFrame) -> DataFrame:
    """Detections per target-hour of the returned span, at most 1."""
    span = (F.unix_micros(F.max("timestamp_utc")) - F.unix_micros(F.min("timestamp_utc"))) / F.lit(3_600_000_000)
    hours = F.greatest(F.floor(span) + 1, F.lit(1))
    targets = F.greatest(F.count_distinct("target"), F.lit(1))
    return events.agg(F.least(F.count(F.lit(1)) / (hours * targets), F.lit(1.0)).alias("effective_anomaly_rate"))


def dispatch_summary(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Charge range, throughput, cycles and peak reduction of each run.

    ``runs`` has peaks and ``configuration_json`` with the battery's capacity and the step.
    """
    sums = points.groupBy("dispatch_run_id").agg(
        F.min("soc_start_mwh").alias("minimum_soc_mwh"),
        F.max("soc_end_mwh").alias("maximum_soc_mwh"),
        F.sum(F.col("charge_mw") + F.col("discharge_mw")).alias("_moved"),
    )
    config = F.from_json("configuration_json", "battery struct<capacity_mwh double>, capacity_mwh double, step_hours double")
    joined = runs.withColumn("_c", config).join(sums, "dispatch_run_id", "left")
    step = F.coalesce(F.nullif(F.col("_c.step_hours"), F.lit(0.0)), F.lit(1.0))
    capacity = F.coalesce("_c.battery.capacity_mwh", "_c.capacity_mwh")
    moved = F.coalesce(F.col("_moved"), F.lit(0.0)) * step
    return joined.select(
        "dispatch_run_id",
        (F.col("peak_before_mw") - F.col("peak_after_mw")).alias("peak_reduction_mw"),
        "minimum_soc_mwh",
        "maximum_soc_mwh",
        moved.alias("total_throughput_mwh"),
        F.try_divide(moved, 2.0 * capacity).alias("equivalent_cycles"),
    )
