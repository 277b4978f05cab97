"""Rolling-origin windows that are valid in every entity at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilohour.errors import InsufficientHistory
from kilohour.functions.intervals import meet
from kilohour.functions.ordered import side_by_side
from kilohour.operators.continuity import segment_rows, segment_table
from kilohour.series import HOURLY, SeriesSpec


def eligible_origins(
    segments: DataFrame, *, horizon: int, required_history: int, spec: SeriesSpec = HOURLY
) -> DataFrame:
    """Intervals of origins with enough history before and a whole horizon after, in all entities.

    Works on segment bounds, not rows: each segment allows one interval of origins, and a running
    count of opened minus closed intervals finds where all entities agree. Intervals are summed per
    instant first, so the final ordered pass sees at most one row per grid step of the calendar.
    """
    allowed = segments.select(
        *spec.entity,
        spec.shift("segment_start", required_history - 1).alias("_from"),
        spec.shift("segment_end", -horizon).alias("_to"),
    ).where("_from <= _to")
    entities = segments.select(F.count_distinct(*spec.entity).alias("_entities"))
    marks = F.array(
        F.struct(F.col("_from").alias("at"), F.lit(1).alias("d")),
        F.struct(spec.shift("_to", 1).alias("at"), F.lit(-1).alias("d")),
    )
    deltas = allowed.select(F.inline(marks)).groupBy("at").agg(F.sum("d").alias("d"))
    ordered = Window.orderBy("at")
    running = deltas.select(
        "at",
        F.sum("d").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_open"),
        F.lead("at").over(ordered).alias("_next"),
    )
    # One-row aggregate joined to calendar instants.
    return (
        running.join(F.broadcast(entities), F.col("_open") == F.col("_entities"))
        .select(F.col("at").alias("first_origin"), spec.shift("_next", -1).alias("last_origin"))
        .where(F.col("last_origin").isNotNull())
    )


def select_windows(
    df: DataFrame,
    *,
    horizon: int,
    windows: int,
    step_size: int,
    required_history: int,
    spec: SeriesSpec = HOURLY,
    require_all: bool = True,
) -> DataFrame:
    """Pick windows backwards from the newest possible origin.

    After an accepted origin the cursor moves back by ``step_size``; otherwise by one step. Columns:
    ``validation_window`` (1 = oldest), ``origin``, ``validation_start``, ``validation_end``.
    """
    if min(horizon, windows, step_size, required_history) <= 0:
        raise ValueError("horizon, windows, step_size and required_history must be positive")
    segments = segment_table(segment_rows(df.select(*spec.key), spec), spec)
    return _pick(segments, horizon, windows, step_size, required_history, spec, require_all)


def _pick(segments, horizon, windows, step_size, required_history, spec, require_all) -> DataFrame:
    bounds = _cursor_bounds(segments, horizon, required_history, spec)
    intervals = eligible_origins(segments, horizon=horizon, required_history=required_history, spec=spec)
    # Intervals are disjoint and newest first; their number is bounded by the calendar.
    spans = intervals.select(
        F.sort_array(
            F.collect_list(
                F.struct(F.unix_micros("last_origin").alias("hi"), F.unix_micros("first_origin").alias("lo"))
            ),
            asc=False,
        ).alias("_spans")
    )
    micros = spec.step_us

    def visit(state, span):
        # Origins start, start - step, ... inside the span, on the cursor's own grid of whole steps.
        offset = F.pmod(state["cursor"] - span["hi"], F.lit(micros))
        top = F.least(state["cursor"], span["hi"] - F.when(offset == 0, 0).otherwise(F.lit(micros) - offset))
        room = F.floor((top - span["lo"]) / F.lit(micros * step_size)) + 1
        take = F.least(F.greatest(room, F.lit(0)), F.lit(windows) - F.size(state["picked"])).cast("int")
        more = F.when(
            take > 0, F.transform(F.sequence(F.lit(1), take), lambda i: top - (i - 1) * F.lit(micros * step_size))
        ).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            F.when(take > 0, top - take * F.lit(micros * step_size)).otherwise(state["cursor"]).alias("cursor"),
            F.concat(state["picked"], more).alias("picked"),
        )

    start = F.struct(
        F.unix_micros("_newest").alias("cursor"), F.array().cast("array<bigint>").alias("picked")
    )
    picked = (
        side_by_side(spans, bounds)
        .select(F.aggregate("_spans", start, visit)["picked"].alias("_p"))
        .select(F.posexplode("_p").alias("_i", "_us"), F.size("_p").alias("_n"))
        .select((F.col("_n") - F.col("_i")).alias("validation_window"), F.timestamp_micros("_us").alias("origin"))
        .withColumn("validation_start", spec.shift("origin", 1))
        .withColumn("validation_end", spec.shift("origin", horizon))
    )
    if require_all:
        found = picked.count()
        if found != windows:
            raise InsufficientHistory(f"{windows} windows requested, {found} valid; horizon {horizon}")
    return picked


def _cursor_bounds(segments: DataFrame, horizon: int, required_history: int, spec: SeriesSpec) -> DataFrame:
    per_entity = segments.groupBy(*spec.entity).agg(
        F.min("segment_start").alias("_a"), F.max("segment_end").alias("_b")
    )
    ends = per_entity.agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"))
    return ends.select(
        spec.shift("_b", -horizon).alias("_newest"), spec.shift("_a", required_history - 1).alias("_oldest")
    )


def window_audit(
    df: DataFrame,
    *,
    horizon: int,
    windows: int,
    step_size: int,
    required_history: int,
    spec: SeriesSpec = HOURLY,
) -> DataFrame:
    """Every candidate origin the search visits, accepted or with the reasons per entity.

    A gap can only spoil origins near it, so gaps meet candidates in an equi-join on dyadic ranges of the time
    grid, a few rows for a gap of any length, instead of testing every candidate in every entity.
    """
    segments = segment_table(segment_rows(df.select(*spec.key), spec), spec)
    chosen = _pick(segments, horizon, windows, step_size, required_history, spec, False)
    bounds = _cursor_bounds(segments, horizon, required_history, spec)
    origins = chosen.agg(F.sort_array(F.collect_list("origin"), asc=False).alias("_o"))
    # Stretches of visited origins: from the cursor down to the pick, then on from one step earlier.
    tops = F.concat(F.array("_newest"), F.transform("_o", lambda o: spec.shift(o, -step_size)))
    stops = F.when(
        F.size("_o") < windows, F.concat("_o", F.array("_oldest"))
    ).otherwise(F.col("_o"))
    step = F.make_dt_interval(secs=F.lit(spec.step_seconds))
    candidates = (
        side_by_side(origins, bounds)
        .select("_o", tops.alias("_tops"), stops.alias("_stops"))
        .select("_o", F.posexplode("_stops").alias("_i", "_stop"), "_tops")
        .withColumn("_top", F.element_at("_tops", F.col("_i") + 1))
        .where("_stop <= _top")
        .select(F.explode(F.sequence("_stop", "_top", step)).alias("origin"), "_o")
        .select("origin", F.array_contains("_o", F.col("origin")).alias("accepted"))
    )
    prior = spec.shift("segment_start", 0)
    gaps = segments.where("gap_before_hours > 0").select(
        *spec.entity,
        F.timestamp_micros(
            F.unix_micros(prior) - F.round(F.col("gap_before_hours") * spec.step_us).cast("long")
        ).alias("_before"),
        F.col("segment_start").alias("_after"),
    )
    hits = meet(
        candidates.where(~F.col("accepted")), gaps, point=spec.grid("origin"), salt=spec.entity,
        low=spec.grid(spec.shift("_before", -horizon)), high=spec.grid(spec.shift("_after", required_history)),
    )
    history_from = spec.shift("origin", 1 - required_history)
    horizon_to = spec.shift("origin", horizon)
    spoiled = hits.where((F.col("_after") > history_from) & (F.col("_before") < horizon_to))
    missing_history = _steps_inside(history_from, F.col("origin"), spec)
    missing_horizon = _steps_inside(spec.shift("origin", 1), horizon_to, spec)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in spec.entity])
    per_entity = spoiled.groupBy("origin", name.alias("_name")).agg(
        F.sum(missing_history).alias("_h"), F.sum(missing_horizon).alias("_v")
    )
    # The reasons are values of an output column.
    texts = F.array_compact(
        F.array(
            F.when(F.col("_h") > 0, F.format_string("%s:insufficient_contiguous_history:%d_missing_hours", "_name", "_h")),
            F.when(F.col("_v") > 0, F.format_string("%s:incomplete_forecast_horizon:%d_missing_hours", "_name", "_v")),
            F.when(
                (F.col("_h") == 0) & (F.col("_v") == 0),
                F.concat("_name", F.lit(":window_crosses_segment_boundary")),
            ),
        )
    )
    reasons = per_entity.withColumn("reason", F.explode(texts)).select("origin", "reason")
    return candidates.join(reasons, "origin", "left")


def _steps_inside(first, last, spec: SeriesSpec):
    """Steps of the candidate's grid in [first, last] strictly between ``_before`` and ``_after``."""
    us, step = F.unix_micros, F.lit(spec.step_us)
    from_first = F.greatest(F.floor((us("_before") - us(first)) / step) + 1, F.lit(0))
    to_last = F.least(F.ceil((us("_after") - us(first)) / step) - 1, F.floor((us(last) - us(first)) / step))
    return F.greatest(to_last - from_first + 1, F.lit(0)).cast("long")


def reserve_final_evaluation(df: DataFrame, windows: DataFrame, spec: SeriesSpec = HOURLY) -> tuple[DataFrame, DataFrame]:
    """Rows before, and from, the earliest validation time of the chosen windows.

    The one instant is read first, so that both filters reach the scan.
    """
    start = windows.agg(F.min("validation_start")).first()[0]
    if start is None:
        raise InsufficientHistory("no validation window to reserve")
    return df.where(F.col(spec.time) < F.lit(start)), df.where(F.col(spec.time) >= F.lit(start))


def common_times(df: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Times at which every entity has a value."""
    entities = df.select(F.count_distinct(*spec.entity).alias("_n"))  # one row
    present = df.where(F.col(spec.value).isNotNull()).groupBy(spec.time).agg(
        F.count_distinct(*spec.entity).alias("_have")
    )
    return present.join(F.broadcast(entities), F.col("_have") == F.col("_n")).select(spec.time)
