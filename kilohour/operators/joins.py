"""Joins of the time-series model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.errors import ContractViolation
from kilohour.functions.ordered import keep_last
from kilohour.series import HOURLY, SeriesSpec

GRID_KEYS = HOURLY.key


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str] = GRID_KEYS) -> DataFrame:
    """Inner join on entity and time."""
    return left.join(right, list(keys), "inner")


def left_context(
    left: DataFrame, context: DataFrame, keys: Sequence[str], columns: Sequence[str], precedence: Sequence[str] = ()
) -> DataFrame:
    """Attach context columns; the context is reduced to one row per key first."""
    right = keep_last(context.select(*dict.fromkeys([*keys, *columns, *precedence])), list(keys), list(precedence))
    return left.join(right.select(*keys, *columns), list(keys), "left")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The 'one' side of a join must hold each key once."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ContractViolation(f"{what} repeats {list(keys)}")
    return df


def checked_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "many_to_one"
) -> DataFrame:
    """Join with the stated cardinality checked before the join."""
    require_unique(right, keys, "right side")
    if validate == "one_to_one":
        require_unique(left, keys, "left side")
    return left.join(right, list(keys), how)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def outer_with_origin(left: DataFrame, right: DataFrame, keys: Sequence[str] = GRID_KEYS) -> DataFrame:
    """Full outer join with ``side`` telling where a row came from."""
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(keys), "full")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return joined.withColumn("side", side).drop("_l", "_r")


def uncovered(source: DataFrame, counterpart: DataFrame, keys: Sequence[str] = GRID_KEYS) -> DataFrame:
    """Distinct keys of the source without any counterpart row."""
    return source.select(*keys).distinct().join(counterpart.select(*keys), list(keys), "left_anti")


def covered(source: DataFrame, counterpart: DataFrame, keys: Sequence[str] = GRID_KEYS) -> DataFrame:
    return source.join(counterpart.select(*keys), list(keys), "left_semi")


def future_and_history(history: DataFrame, future: DataFrame, keys: Sequence[str] = GRID_KEYS) -> DataFrame:
    """History and future weather on one time axis; history values win where both exist."""
    shared = [c for c in history.columns if c in future.columns and c not in keys]
    only_future = [c for c in future.columns if c not in history.columns]
    renamed = future.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in shared], *only_future)
    joined = history.join(renamed, list(keys), "full")
    out = [F.coalesce(F.col(c), F.col(f"_f_{c}")).alias(c) if c in shared else F.col(c) for c in history.columns]
    return joined.select(*out, *only_future)


def overlap_report(grid: DataFrame, other: DataFrame, keys: Sequence[str] = GRID_KEYS) -> DataFrame:
    """Rows on each side and on both."""
    joined = outer_with_origin(grid.select(*keys), other.select(*keys), keys)
    return joined.agg(
        F.count_if(F.col("side") != "right_only").alias("left_rows"),
        F.count_if(F.col("side") != "left_only").alias("right_rows"),
        F.count_if(F.col("side") == "both").alias("overlap_rows"),
    )


def net_load(demand: DataFrame, renewable: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Demand minus total renewables where both are known."""
    both = aligned(
        demand.select(*spec.key, "demand_mw"), renewable.select(*spec.key, "total_renewable_generation_mw"), spec.key
    )
    known = both.where(F.col("demand_mw").isNotNull() & F.col("total_renewable_generation_mw").isNotNull())
    return known.withColumn("net_load_mw", F.col("demand_mw") - F.col("total_renewable_generation_mw"))


def net_load_report(demand: DataFrame, renewable: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    joined = outer_with_origin(
        demand.select(*spec.key, "demand_mw"), renewable.select(*spec.key, "total_renewable_generation_mw"), spec.key
    )
    usable = (
        (F.col("side") == "both") & F.col("demand_mw").isNotNull() & F.col("total_renewable_generation_mw").isNotNull()
    )
    return joined.agg(
        F.count_if(F.col("side") != "right_only").alias("demand_rows"),
        F.count_if(F.col("side") != "left_only").alias("renewable_rows"),
        F.count_if(F.col("side") == "both").alias("overlap_rows"),
        F.count_if(usable).alias("net_load_available_rows"),
        F.count_if(~usable).alias("missing_overlap_rows"),
    )


def create_net_load_view(demand: DataFrame, renewable: DataFrame, name: str = "target_net_load") -> DataFrame:
    """Register the complete-case net load as a temporary view."""
    view = net_load(demand, renewable)
    view.createOrReplaceTempView(name)
    return view


def component_net_load(demand: DataFrame, solar: DataFrame, wind: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Net load from three component forecasts over identical windows."""
    joined = (
        demand.select(*keys, F.col("predicted_value").alias("_d"))
        .join(solar.select(*keys, F.col("predicted_value").alias("_s")), list(keys), "full")
        .join(wind.select(*keys, F.col("predicted_value").alias("_w")), list(keys), "full")
    )
    return joined.select(*keys, (F.col("_d") - F.col("_s") - F.col("_w")).alias("predicted_value"))


def target_frame(
    target: str, demand: DataFrame, renewables: DataFrame | None = None, *, start: object = None, end: object = None,
    spec: SeriesSpec = HOURLY,
) -> DataFrame:
    """Rows of one target inside an inclusive range; net load comes with its two components."""
    if target == "demand_mw":
        rows = demand.select(*spec.key, target)
    elif target == "net_load_mw":
        rows = net_load(demand, renewables, spec)
    else:
        rows = renewables.select(*spec.key, target)
    if start is not None:
        rows = rows.where(F.col(spec.time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col(spec.time) <= F.lit(end).cast("timestamp"))
    return rows
