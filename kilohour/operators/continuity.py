"""Contiguous segments of a series and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohour.errors import ConflictingDuplicates
from kilohour.functions.ordered import walk
from kilohour.series import HOURLY, SeriesSpec

SEGMENT = "region_segment_id"


def previous_times(df: DataFrame, spec: SeriesSpec = HOURLY, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``prev_time``, the time of the previous row of the entity."""
    keys = [*spec.entity, *extra_keys]
    out = walk(df, keys=keys, order=[spec.time], chunk=spec.chunk())
    return out.withColumn("prev_time", F.col("_prev")[spec.time]).drop("_prev")


def gap_steps(spec: SeriesSpec, prev: str = "prev_time") -> Column:
    """Whole steps missing between the previous row and this one."""
    steps = F.floor(spec.steps_between(F.col(prev), F.col(spec.time)))
    return F.greatest(F.coalesce(steps, F.lit(1)) - 1, F.lit(0)).cast("long")


def segment_rows(df: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Annotate rows with a segment id that restarts whenever the step is not exact."""
    step = F.lit(spec.step_us)

    def broken(prev, cur):
        return F.unix_micros(cur(spec.time)) - F.unix_micros(prev(spec.time)) != step

    marked = walk(df, keys=spec.entity, order=[spec.time], chunk=spec.chunk(), breaks=broken, island="segment_no")
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in spec.entity])
    return (
        marked.withColumn(SEGMENT, F.format_string("%s::%04d", name, F.col("segment_no")))
        .withColumn("prev_time", F.col("_prev")[spec.time])
        .drop("_prev")
    )


def segment_table(rows: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """One row per segment: bounds, size and the gap before it. Takes ``segment_rows`` output."""
    grouped = rows.groupBy(*spec.entity, "segment_no", SEGMENT).agg(
        F.min(spec.time).alias("segment_start"),
        F.max(spec.time).alias("segment_end"),
        F.count(F.lit(1)).alias("row_count"),
        F.min("prev_time").alias("_prior_end"),
    )
    gap = F.coalesce(spec.steps_between(F.col("_prior_end"), F.col("segment_start")), F.lit(0.0))
    return (
        grouped.withColumn("_prior_end", F.when(F.col("_prior_end") < F.col("segment_start"), F.col("_prior_end")))
        .withColumn("duration_hours", spec.steps_between(F.col("segment_start"), F.col("segment_end")) + 1.0)
        .withColumn("gap_before_hours", gap)
        .withColumn(
            "missing_expected_hours_before",
            F.when(F.col("gap_before_hours") > 1, F.floor("gap_before_hours") - 1).otherwise(0).cast("long"),
        )
        .drop("_prior_end")
    )


def detect_segments(df: DataFrame, spec: SeriesSpec = HOURLY) -> tuple[DataFrame, DataFrame]:
    """Annotated rows and the segment table; duplicate keys are an error."""
    if not df.groupBy(*spec.key).count().where("count > 1").isEmpty():
        raise ConflictingDuplicates("continuity input repeats an entity and time")
    rows = segment_rows(df, spec)
    return rows, segment_table(rows, spec)


def continuity_summary(segments: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """One row of totals over all segments; the longest wins, later start on ties."""
    longest = F.max_by(F.struct("row_count", "duration_hours", SEGMENT), F.struct("row_count", "segment_start", SEGMENT))
    recent = F.max_by(F.struct(SEGMENT, "segment_start", "segment_end"), F.struct("segment_end", SEGMENT))
    agg = segments.agg(
        F.count_distinct(*spec.entity).alias("region_count"),
        F.sum("missing_expected_hours_before").alias("timestamp_gap_count"),
        F.count_if(F.col("gap_before_hours") > 1).alias("gap_event_count"),
        F.count(F.lit(1)).alias("contiguous_segment_count"),
        longest.alias("_l"),
        recent.alias("_r"),
    )
    return agg.select(
        "region_count", "timestamp_gap_count", "gap_event_count", "contiguous_segment_count",
        F.col("_l.row_count").alias("longest_contiguous_segment_rows"),
        F.col("_l.duration_hours").alias("longest_contiguous_segment_hours"),
        F.col(f"_l.{SEGMENT}").alias("longest_contiguous_segment"),
        F.col(f"_r.{SEGMENT}").alias("most_recent_contiguous_segment"),
        F.col("_r.segment_end").alias("most_recent_segment_end"),
    )


def longest_segments(segments: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """The longest segment of each entity, latest start on ties."""
    best = F.max_by(
        F.struct(SEGMENT, "segment_start", "segment_end", "row_count"), F.struct("row_count", "segment_start")
    )
    return segments.groupBy(*spec.entity).agg(best.alias("_b")).select(*spec.entity, "_b.*")


def latest_segments(segments: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """The most recent segment of each entity and its length: the history a forecast can use."""
    best = F.max_by(F.struct(SEGMENT, "segment_start", "segment_end", "row_count"), F.col("segment_end"))
    return segments.groupBy(*spec.entity).agg(best.alias("_b")).select(*spec.entity, "_b.*")


def missing_steps(df: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Every grid step absent between the first and last row of an entity, with its gap size.

    The grid is anchored at each entity's first row.
    """
    first = df.groupBy(*spec.entity).agg(F.min(spec.time).alias("_first"))
    linked = previous_times(df, spec).where(F.col("prev_time").isNotNull())
    wide = linked.where(spec.steps_between(F.col("prev_time"), F.col(spec.time)) > 1.0).join(first, list(spec.entity))
    lower = F.floor(spec.steps_between(F.col("_first"), F.col("prev_time"))) + 1
    upper = F.ceil(spec.steps_between(F.col("_first"), F.col(spec.time))) - 1
    size = F.greatest(F.floor(spec.steps_between(F.col("prev_time"), F.col(spec.time))) - 1, F.lit(1))
    return (
        wide.withColumn("gap_hours", size.cast("long"))
        .withColumn("_lower", lower)
        .withColumn("_upper", upper)
        .where("_lower <= _upper")
        .withColumn("_k", F.explode(F.sequence("_lower", "_upper")))
        .select(*spec.entity, spec.shift("_first", F.col("_k")).alias(spec.time), "gap_hours")
    )


def irregular_steps(df: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Rows whose distance to the previous row is not one step."""
    linked = previous_times(df, spec)
    return linked.where(spec.steps_between(F.col("prev_time"), F.col(spec.time)) != 1.0)


def align_to_grid(df: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Every expected step of each entity from its first to its last row; absent rows get nulls."""
    bounds = df.groupBy(*spec.entity).agg(F.min(spec.time).alias("_a"), F.max(spec.time).alias("_b"))
    # Chunks are exploded first and steps second, so one long entity spreads over tasks.
    last = F.floor(spec.steps_between(F.col("_a"), F.col("_b"))).cast("long")
    chunks = bounds.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / spec.chunk_rows))))
    start = F.col("_c") * spec.chunk_rows
    spine = chunks.withColumn("_k", F.explode(F.sequence(start, F.least(start + spec.chunk_rows - 1, last)))).select(
        *spec.entity, spec.shift("_a", F.col("_k")).alias(spec.time)
    )
    return spine.join(df.withColumn("is_present", F.lit(True)), spec.key, "left").withColumn(
        "is_present", F.coalesce("is_present", F.lit(False))
    )
