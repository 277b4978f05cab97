"""Battery dispatch: inputs, policies, audits and key figures for whole fleets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilohour.contracts import DISPATCH_INPUT_COLUMNS, DISPATCH_POINT_COLUMNS, Contract
from kilohour.errors import ContractViolation, InsufficientHistory
from kilohour.functions.ordered import walk
from kilohour.functions.scoring import clamp
from kilohour.series import HOURLY
from kilohour.operators.joins import checked_join
from kilohour.session import cut_lineage

# Columns of the battery table.
BATTERY_NUMBERS = (
    "capacity_mwh", "max_charge_mw", "max_discharge_mw", "min_soc_mwh", "max_soc_mwh", "initial_soc_mwh",
    "terminal_soc_target_mwh", "charge_efficiency", "discharge_efficiency", "self_discharge_rate",
    "maximum_daily_cycles", "degradation_cost_per_mwh", "reserve_soc_mwh",
)
REALISED = (
    "demand_forecast_mw", "solar_forecast_mw", "wind_forecast_mw", "renewable_forecast_mw", "net_load_before_battery_mw",
)
SMALL_POWER = 1e-7
AUDIT_TOLERANCE = 1e-5


def battery_contract(columns: Sequence[str] = ("battery_id", *BATTERY_NUMBERS)) -> Contract:
    c = F.col
    checks = {
        "battery_id_not_blank": F.trim("battery_id") != "",
        "power_and_capacity_positive": F.least("capacity_mwh", "max_charge_mw", "max_discharge_mw") > 0,
        "soc_bounds": (c("min_soc_mwh") >= 0) & (c("min_soc_mwh") < c("max_soc_mwh")) & (c("max_soc_mwh") <= c("capacity_mwh")),
        "soc_levels_within_bounds": (F.least("initial_soc_mwh", "terminal_soc_target_mwh", "reserve_soc_mwh") >= c("min_soc_mwh"))
        & (F.greatest("initial_soc_mwh", "terminal_soc_target_mwh", "reserve_soc_mwh") <= c("max_soc_mwh")),
        "efficiencies": (F.least("charge_efficiency", "discharge_efficiency") > 0)
        & (F.greatest("charge_efficiency", "discharge_efficiency") <= 1),
        "self_discharge": (c("self_discharge_rate") >= 0) & (c("self_discharge_rate") < 1),
        "cycles_and_cost": (c("maximum_daily_cycles") > 0) & (c("degradation_cost_per_mwh") >= 0),
    }
    return Contract("batteries", tuple(columns), checks, ("battery_id",))


def effective_min_soc() -> Column:
    return F.greatest("min_soc_mwh", "reserve_soc_mwh")


def soc_after(soc: Column, charge: Column, discharge: Column, hours: float = 1.0) -> Column:
    """State of charge after one step; needs the battery's columns."""
    kept = soc * F.pow(F.lit(1.0) - F.col("self_discharge_rate"), F.lit(hours))
    return kept + charge * F.col("charge_efficiency") * hours - discharge / F.col("discharge_efficiency") * hours


def operating_mode(charge: Column, discharge: Column) -> Column:
    return F.when(charge > SMALL_POWER, "charge").when(discharge > SMALL_POWER, "discharge").otherwise("idle")


def renewable_share() -> Column:
    return clamp(F.col("renewable_forecast_mw") / F.greatest("demand_forecast_mw", F.lit(1e-12)), 0.0, 1.0)


# -- inputs -----------------------------------------------------------------------------------


def mixed_lineage(forecasts: DataFrame) -> DataFrame:
    """Series of one (region, origin, target) that come from more than one model run."""
    identity = F.struct("model_name", "model_version", "run_id", "weather_mode")
    return (
        forecasts.groupBy("region", "forecast_origin", "target")
        .agg((F.min(identity) != F.max(identity)).alias("mixed"))
        .where("mixed")
        .drop("mixed")
    )


def first_steps(forecasts: DataFrame, horizon: int) -> DataFrame:
    """First ``horizon`` rows of every target series of an origin; a series is one forecast horizon."""
    order = Window.partitionBy("region", "forecast_origin", "target").orderBy("timestamp_utc")
    return forecasts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= horizon).drop("_n")


def dispatch_inputs(
    forecasts: DataFrame, *, horizon: int, prices: DataFrame | None = None, fallback_price: float = 0.0,
    check: bool = True,
) -> DataFrame:
    """Dispatch rows of every (region, origin): spine, components, derived loads and prices.

    Whether a component is taken, derived or zero is decided per origin from the series it has; an
    hour missing inside a series it has stays null and fails the input contract.
    """
    if check and not mixed_lineage(forecasts).isEmpty():
        raise ContractViolation("a target mixes model runs at one origin")
    names = {
        "_demand": "demand_mw", "_net": "net_load_mw", "_solar": "solar_generation_mw", "_wind": "wind_generation_mw",
        "_total": "total_renewable_generation_mw",
    }
    key = ["region", "forecast_origin"]
    target = F.col("target")
    used = first_steps(forecasts, horizon)
    wide = used.groupBy(*key, "timestamp_utc").agg(
        *[F.max(F.when(target == t, F.col("predicted_value"))).alias(n) for n, t in names.items()]
    )
    identity = F.struct("model_name", "model_version", "run_id", "weather_mode")
    heads = used.groupBy(*key).agg(
        *[F.bool_or(target == t).alias(f"has{n}") for n, t in names.items()],
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(target, identity)))).alias("_lineage"),  # five targets
    )
    if check and not heads.where("NOT has_demand AND NOT has_net").isEmpty():
        raise InsufficientHistory("dispatch needs demand or net-load forecasts at every origin")
    steps = heads.withColumn("forecast_step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "timestamp_utc", HOURLY.shift("forecast_origin", F.col("forecast_step"))
    )
    rows = steps.join(wide, [*key, "timestamp_utc"], "left")
    if prices is not None:
        on = [c for c in ("region", "timestamp_utc") if c in prices.columns]
        rows = rows.join(prices.select(*on, F.col("energy_price").cast("double").alias("_price")), on, "left")
        price = F.col("_price")
    else:
        price = F.lit(float(fallback_price))
    solar = F.when(F.col("has_solar"), F.col("_solar")).otherwise(0.0)
    wind = F.when(F.col("has_wind"), F.col("_wind")).otherwise(0.0)
    renewable = F.when(F.col("has_total"), F.col("_total")).otherwise(solar + wind)
    demand = F.when(F.col("has_demand"), F.col("_demand")).otherwise(F.col("_net") + renewable)
    net = F.when(F.col("has_net"), F.col("_net")).otherwise(demand - renewable)
    return rows.select(
        *key, "timestamp_utc", "forecast_step",
        demand.alias("demand_forecast_mw"), solar.alias("solar_forecast_mw"), wind.alias("wind_forecast_mw"),
        renewable.alias("renewable_forecast_mw"), net.alias("net_load_before_battery_mw"),
        price.alias("energy_price"), F.to_json(F.struct(F.col("_lineage").alias("forecast_lineage"))).alias("metadata_json"),
    ).select(*DISPATCH_INPUT_COLUMNS)


def _with_metadata(**fields: Column) -> Column:
    """``metadata_json`` with fields added or replaced; nested values stay JSON."""
    kind = "map<string,variant>"
    old = F.coalesce(F.from_json("metadata_json", kind), F.create_map().cast(kind))
    names = F.array(*[F.lit(n) for n in fields])
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(names, k))
    added = F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v.cast("variant"))])
    return F.to_json(F.map_concat(kept, added))


def robust_inputs(inputs: DataFrame, *, demand_uplift_pct: float, renewable_reduction_pct: float) -> DataFrame:
    """Demand raised and renewables lowered by margins; net load follows, the originals stay in the metadata."""
    if min(demand_uplift_pct, renewable_reduction_pct) < 0:
        raise ValueError("margins must not be negative")
    up, down = 1.0 + demand_uplift_pct, 1.0 - renewable_reduction_pct
    margins = F.to_json(
        F.struct(F.lit(demand_uplift_pct).alias("demand_uplift_pct"), F.lit(renewable_reduction_pct).alias("renewable_reduction_pct"))
    )
    return inputs.withColumn(
        "metadata_json",
        _with_metadata(
            robust_adjustments=F.parse_json(margins),
            unadjusted_demand_forecast_mw=F.col("demand_forecast_mw"),
            unadjusted_renewable_forecast_mw=F.col("renewable_forecast_mw"),
        ),
    ).withColumns(
        {
            "demand_forecast_mw": F.col("demand_forecast_mw") * up,
            "solar_forecast_mw": F.col("solar_forecast_mw") * down,
            "wind_forecast_mw": F.col("wind_forecast_mw") * down,
            "renewable_forecast_mw": F.col("renewable_forecast_mw") * down,
            "net_load_before_battery_mw": F.col("demand_forecast_mw") * up - F.col("renewable_forecast_mw") * down,
        }
    )


def robust_batteries(batteries: DataFrame, extra_reserve_pct: float) -> DataFrame:
    """Reserve raised by a share of capacity; beyond the charge limit it is an error."""
    raised = batteries.withColumn("reserve_soc_mwh", F.col("reserve_soc_mwh") + F.col("capacity_mwh") * extra_reserve_pct)
    if not raised.where("reserve_soc_mwh > max_soc_mwh").isEmpty():
        raise ContractViolation("reserve margin exceeds the maximum charge of a battery")
    return raised


def historical_actuals(demand: DataFrame, renewables: DataFrame) -> DataFrame:
    """Observed values under the dispatch column names, where both sides exist."""
    both = checked_join(demand.select("region", "timestamp_utc", "demand_mw"), renewables, HOURLY.key, "inner", "one_to_one")
    return both.select(
        "region", "timestamp_utc", F.col("demand_mw").alias("demand_forecast_mw"),
        F.col("solar_generation_mw").alias("solar_forecast_mw"), F.col("wind_generation_mw").alias("wind_forecast_mw"),
        F.col("total_renewable_generation_mw").alias("renewable_forecast_mw"),
        (F.col("demand_mw") - F.col("total_renewable_generation_mw")).alias("net_load_before_battery_mw"),
    )


def _with_actuals(rows: DataFrame, actuals: DataFrame, check: bool) -> DataFrame:
    # Stored, so their size is known: few observations are broadcast, and the schedule is not shuffled to meet them.
    real = cut_lineage(actuals.select("region", "timestamp_utc", *[F.col(c).alias(f"_real_{c}") for c in REALISED]))
    joined = checked_join(rows, real, HOURLY.key) if check else rows.join(real, HOURLY.key, "left")
    lacking = F.lit(False)
    for c in REALISED:
        lacking = lacking | F.col(f"_real_{c}").isNull()
    if check and not joined.where(lacking).isEmpty():
        raise InsufficientHistory("observations do not cover all dispatch hours")
    return joined


def oracle_inputs(inputs: DataFrame, actuals: DataFrame, check: bool = True) -> DataFrame:
    """Forecast columns replaced by observed values; every hour must have them."""
    joined = _with_actuals(inputs, actuals, check)
    out = {c: F.col(f"_real_{c}") for c in REALISED}
    out["metadata_json"] = _with_metadata(oracle_non_deployable=F.lit(True))
    return joined.withColumns(out).select(*inputs.columns)


def apply_realised(schedule: DataFrame, actuals: DataFrame, check: bool = True) -> DataFrame:
    """Chosen actions judged on observed values; the forecast moves into the metadata."""
    joined = _with_actuals(schedule, actuals, check)
    forecast = F.to_json(F.struct(*REALISED))
    meta = _with_metadata(optimization_forecast=F.parse_json(forecast), evaluated_on_realized_observation=F.lit(True))
    out = {c: F.col(f"_real_{c}") for c in REALISED}
    out["net_load_after_battery_mw"] = F.col("_real_net_load_before_battery_mw") + F.col("charge_mw") - F.col("discharge_mw")
    return joined.withColumn("metadata_json", meta).withColumns(out).select(*schedule.columns)


def dispatch_ids(inputs: DataFrame, batteries: DataFrame, objective: str = "balanced", robust: bool = False) -> DataFrame:
    """Deterministic run id of every (battery, region, origin); one horizon of rows is hashed."""
    # numbers are hashed as whole millionths, times as seconds: the same text from any engine
    millionths = lambda c: F.coalesce(F.round(F.col(c) * 1e6).cast("long").cast("string"), F.lit("-"))
    values = ["demand_forecast_mw", "renewable_forecast_mw", "net_load_before_battery_mw", "energy_price"]
    row = F.struct(F.unix_seconds("timestamp_utc").alias("at"), F.concat_ws(",", *[millionths(c) for c in values]).alias("text"))
    packed = inputs.groupBy("region", "forecast_origin").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    rows = F.array_join(F.transform("_rows", lambda r: F.concat_ws(",", r["at"].cast("string"), r["text"])), ";")
    material = F.concat_ws(
        "|", "battery_id", *[millionths(c) for c in BATTERY_NUMBERS], "region", F.unix_seconds("forecast_origin").cast("string"), rows,
        F.lit(objective), F.lit(str(robust).lower()),
    )
    return packed.join(batteries, "region").select(
        "region", "forecast_origin", "battery_id", F.substring(F.sha2(material, 256), 1, 32).alias("dispatch_run_id")
    )


# -- policies ---------------------------------------------------------------------------------


def load_thresholds(inputs: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Load quantiles of each horizon; a group is one horizon of rows."""
    level = F.percentile("net_load_before_battery_mw", F.array(F.lit(low), F.lit(high)))
    return inputs.groupBy("region", "forecast_origin").agg(level.alias("_q")).select(
        "region", "forecast_origin", F.col("_q")[0].alias("low_load_mw"), F.col("_q")[1].alias("high_load_mw")
    )


def _fold(rows: str, policy: str, hours: float) -> Column:
    """Ledger of one battery over ordered rows: clamped power and state of charge of every step."""
    decay = F.pow(F.lit(1.0) - F.col("self_discharge_rate"), F.lit(hours))
    kind = "struct<charge:double,discharge:double,soc_start:double,soc_end:double>"

    def wanted(row):
        if policy == "no_battery":
            return F.lit(0.0), F.lit(0.0)
        surplus = row["renewable_forecast_mw"] > row["demand_forecast_mw"]
        net = row["net_load_before_battery_mw"]
        fill = surplus | (net <= row["low_load_mw"])
        drain = ~fill & (net > row["high_load_mw"])
        zero = F.lit(0.0)
        return F.when(fill, F.col("max_charge_mw")).otherwise(zero), F.when(drain, F.col("max_discharge_mw")).otherwise(zero)

    def step(state, row):
        soc = state["soc"]
        charge, discharge = wanted(row)
        room = F.greatest(F.lit(0.0), (F.col("max_soc_mwh") - decay * soc) / (F.col("charge_efficiency") * hours))
        stock = F.greatest(F.lit(0.0), (decay * soc - effective_min_soc()) * F.col("discharge_efficiency") / hours)
        charge, discharge = F.least(charge, "max_charge_mw", room), F.least(discharge, "max_discharge_mw", stock)
        end = soc_after(soc, charge, discharge, hours)
        entry = F.struct(charge.alias("charge"), discharge.alias("discharge"), soc.alias("soc_start"), end.alias("soc_end"))
        return F.struct(end.alias("soc"), F.concat(state["out"], F.array(entry)).alias("out"))

    zero = F.struct(F.col("initial_soc_mwh").alias("soc"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(F.col(rows), zero, step, lambda state: state["out"])


_LEDGER_ROW = (
    "timestamp_utc", "forecast_origin", "forecast_step", *REALISED, "energy_price", "metadata_json", "low_load_mw",
    "high_load_mw",
)


def policy_schedules(
    inputs: DataFrame, batteries: DataFrame, policy: str = "rule_based", *, created_at: Column, hours: float = 1.0
) -> DataFrame:
    """Every battery of a region run over every horizon of that region, each from its initial charge.

    The ledger depends on the step before, so one horizon is folded as an array; batteries and
    origins run in parallel. ``batteries`` carries a ``region`` column.
    """
    packed = _packed(inputs, ["region", "forecast_origin"])
    # Battery and origin pairs are small rows but much work: spread them before the horizons join in.
    tasks = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = packed.select("region", "forecast_origin").join(batteries, "region")
    pairs = pairs.repartition(tasks, "battery_id", "forecast_origin")
    runs = pairs.join(packed, ["region", "forecast_origin"]).withColumn("_out", _fold("_rows", policy, hours))
    exploded = runs.select("region", "battery_id", "degradation_cost_per_mwh", F.explode(F.arrays_zip("_rows", "_out")).alias("_p"))
    return _points(exploded, policy, created_at)


def rolling_schedules(
    inputs: DataFrame, batteries: DataFrame, policy: str = "rule_based", *, created_at: Column, hours: float = 1.0
) -> DataFrame:
    """First action of each origin, with the charge carried from origin to origin.

    The chain of a battery is as long as its origins, which the hourly calendar bounds; batteries
    run in parallel.
    """
    firsts = _with_thresholds(inputs).where("forecast_step = 1")
    packed = firsts.groupBy("region").agg(
        F.sort_array(F.collect_list(F.struct(*_LEDGER_ROW))).alias("_rows")
    )
    runs = packed.join(batteries, "region").withColumn("_out", _fold("_rows", policy, hours))
    exploded = runs.select("region", "battery_id", "degradation_cost_per_mwh", F.explode(F.arrays_zip("_rows", "_out")).alias("_p"))
    return _points(exploded, policy, created_at)


def _with_thresholds(inputs: DataFrame) -> DataFrame:
    return inputs.join(load_thresholds(inputs), ["region", "forecast_origin"])


def _packed(inputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of one horizon as a time-ordered array with the horizon's load quantiles."""
    rows = F.sort_array(F.collect_list(F.struct(*_LEDGER_ROW)))
    return _with_thresholds(inputs).groupBy(*key).agg(rows.alias("_rows"))


def _points(exploded: DataFrame, policy: str, created_at: Column) -> DataFrame:
    row, out = F.col("_p._rows"), F.col("_p._out")
    name = policy.replace("_", "-")
    rows = exploded.select(
        "region", "battery_id", *[row[c].alias(c) for c in _LEDGER_ROW], out["charge"].alias("charge_mw"),
        out["discharge"].alias("discharge_mw"), out["soc_start"].alias("soc_start_mwh"),
        out["soc_end"].alias("soc_end_mwh"), F.col("degradation_cost_per_mwh").alias("marginal_degradation_cost"),
    )
    c, x = F.col("charge_mw"), F.col("discharge_mw")
    return rows.withColumns(
        {
            "dispatch_run_id": F.lit(name),
            "net_battery_power_mw": x - c,
            "net_load_after_battery_mw": F.col("net_load_before_battery_mw") + c - x,
            "operating_mode": operating_mode(c, x),
            "solver_status": F.lit("feasible"),
            "created_at_utc": created_at,
            "metadata_json": _with_metadata(
                baseline=F.lit(name), low_load_threshold_mw=F.col("low_load_mw"), high_load_threshold_mw=F.col("high_load_mw")
            ),
        }
    ).select(*DISPATCH_POINT_COLUMNS)


# -- audits and key figures -------------------------------------------------------------------


def physics_audit(
    schedule: DataFrame, batteries: DataFrame, *, run: Sequence[str] = ("dispatch_run_id",), hours: float = 1.0,
    terminal_required: bool = True, tolerance: float = AUDIT_TOLERANCE, chunk_rows: int = 4096,
) -> DataFrame:
    """Violations of power, charge bounds, continuity, daily cycles and terminal charge per run."""
    run = list(run)
    spec = batteries.select("battery_id", *BATTERY_NUMBERS)
    rows = schedule.select(*run, "battery_id", "timestamp_utc", "charge_mw", "discharge_mw", "soc_start_mwh", "soc_end_mwh")
    linked = walk(
        rows, keys=run, order=["timestamp_utc"], chunk=F.floor(HOURLY.grid("timestamp_utc") / chunk_rows),
        carry=["soc_end_mwh"],
    ).join(spec, "battery_id")
    c, x = F.col("charge_mw"), F.col("discharge_mw")
    t = F.lit(tolerance)
    power = sum(
        (
            condition.cast("int")
            for condition in (c < -t, x < -t, c > F.col("max_charge_mw") + t, x > F.col("max_discharge_mw") + t, (c > t) & (x > t))
        ),
        F.lit(0),
    )
    end = F.col("soc_end_mwh")
    level = (end < effective_min_soc() - t).cast("int") + (end > F.col("max_soc_mwh") + t).cast("int")
    start = F.coalesce(F.col("_prev.soc_end_mwh"), F.col("initial_soc_mwh"))
    chain = (F.abs(F.col("soc_start_mwh") - start) > t).cast("int") + (F.abs(end - soc_after(start, c, x, hours)) > t).cast("int")
    daily = linked.groupBy(*run, F.to_date("timestamp_utc").alias("_day")).agg(
        F.sum(power).alias("power_violations"),
        F.sum(level).alias("soc_violations"),
        F.sum(chain).alias("continuity_violations"),
        F.sum((c + x) * hours).alias("_throughput"),
        F.max_by("soc_end_mwh", "timestamp_utc").alias("_last"),
        *[F.max(n).alias(n) for n in ("capacity_mwh", "maximum_daily_cycles", "terminal_soc_target_mwh")],
    )
    cycles = F.col("_throughput") / (2.0 * F.col("capacity_mwh"))
    totals = daily.groupBy(*run).agg(
        *[F.sum(n).alias(n) for n in ("power_violations", "soc_violations", "continuity_violations")],
        F.count_if(cycles > F.col("maximum_daily_cycles") + t).alias("cycle_violations"),
        F.abs(F.max_by("_last", "_day") - F.max("terminal_soc_target_mwh")).alias("terminal_soc_deviation_mwh"),
        F.sum("_throughput").alias("throughput_mwh"),
        (F.sum("_throughput") / (2.0 * F.max("capacity_mwh"))).alias("equivalent_full_cycles"),
    )
    ended = F.lit(terminal_required) & (F.col("terminal_soc_deviation_mwh") > t)
    totals = totals.withColumn("terminal_violations", ended.cast("int"))
    counts = ("power_violations", "soc_violations", "continuity_violations", "cycle_violations", "terminal_violations")
    return totals.withColumn("valid", F.greatest(*counts) == 0)


def daily_throughput(schedule: DataFrame, batteries: DataFrame, *, run: Sequence[str] = ("dispatch_run_id",), hours: float = 1.0) -> DataFrame:
    day = F.to_date("timestamp_utc").alias("day")
    sums = schedule.groupBy(*run, "battery_id", day).agg(F.sum((F.col("charge_mw") + F.col("discharge_mw")) * hours).alias("throughput_mwh"))
    spec = batteries.select("battery_id", "capacity_mwh")
    cycles = F.col("throughput_mwh") / (2.0 * F.col("capacity_mwh"))
    return sums.join(spec, "battery_id").withColumn("equivalent_cycles", cycles).drop("capacity_mwh")


def evaluate_dispatch(
    schedule: DataFrame, batteries: DataFrame, by: Sequence[str] = ("dispatch_run_id",), *, hours: float = 1.0
) -> DataFrame:
    """Peaks, costs, savings, energy, losses, cycles, degradation and violations per group."""
    spec = batteries.select("battery_id", *BATTERY_NUMBERS)
    rows = schedule.join(spec, "battery_id")
    before, after = F.col("net_load_before_battery_mw"), F.col("net_load_after_battery_mw")
    c, x, price = F.col("charge_mw"), F.col("discharge_mw"), F.col("energy_price")
    t, end = F.lit(AUDIT_TOLERANCE), F.col("soc_end_mwh")
    leak = F.col("soc_start_mwh") * (1.0 - F.pow(F.lit(1.0) - F.col("self_discharge_rate"), F.lit(hours)))
    strong = (c > F.col("max_charge_mw") + t) | (x > F.col("max_discharge_mw") + t) | ((c > t) & (x > t))
    level = (end < effective_min_soc() - t) | (end > F.col("max_soc_mwh") + t)
    loss = F.sum(c * hours) * (1.0 - F.max("charge_efficiency")) + F.sum(x * hours) * (1.0 / F.max("discharge_efficiency") - 1.0)
    sums = rows.groupBy(*by).agg(
        F.max(before).alias("original_peak_load_mw"),
        F.max(after).alias("optimized_peak_load_mw"),
        F.sum(F.greatest(after, F.lit(0.0)) * hours).alias("energy_imported_mwh"),
        F.sum(before * price * hours).alias("original_energy_cost"),
        F.sum(after * price * hours).alias("energy_cost"),
        F.sum(c * renewable_share() * hours).alias("renewable_energy_charged_mwh"),
        F.sum(c * hours).alias("charge_energy_mwh"),
        F.sum(x * hours).alias("discharge_energy_mwh"),
        (F.greatest(loss, F.lit(0.0)) + F.sum(leak)).alias("battery_losses_mwh"),
        F.abs(F.max_by("soc_end_mwh", "timestamp_utc") - F.max("terminal_soc_target_mwh")).alias("terminal_soc_deviation_mwh"),
        F.count_if(level).alias("soc_violations"),
        F.count_if(strong).alias("power_violations"),
        F.max("capacity_mwh").alias("_capacity"),
        F.max("degradation_cost_per_mwh").alias("_wear"),
    )
    gain = F.col("original_peak_load_mw") - F.col("optimized_peak_load_mw")
    moved = F.col("charge_energy_mwh") + F.col("discharge_energy_mwh")
    return sums.withColumns(
        {
            "absolute_peak_reduction_mw": gain,
            "percentage_peak_reduction": F.coalesce(F.try_divide(gain * 100.0, F.col("original_peak_load_mw")), F.lit(0.0)),
            "energy_cost_savings": F.col("original_energy_cost") - F.col("energy_cost"),
            "total_throughput_mwh": moved,
            "equivalent_full_cycles": moved / (2.0 * F.col("_capacity")),
            "degradation_cost": moved * F.col("_wear"),
        }
    ).drop("_capacity", "_wear")


def compare_strategies(
    schedules: dict[str, DataFrame], batteries: DataFrame, by: Sequence[str] = (), *, hours: float = 1.0
) -> DataFrame:
    """Key figures per strategy (and further columns) over the union of their schedules."""
    parts = [df.withColumn("strategy", F.lit(name)) for name, df in schedules.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return evaluate_dispatch(rows, batteries, [*by, "strategy"], hours=hours).orderBy(*by, "strategy")


def daily_metrics(schedule: DataFrame, batteries: DataFrame, by: Sequence[str] = (), *, hours: float = 1.0) -> DataFrame:
    rows = schedule.withColumn("day_utc", F.date_format("timestamp_utc", "yyyy-MM-dd"))
    return evaluate_dispatch(rows, batteries, [*by, "day_utc"], hours=hours)


def metric_rows(metrics: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per metric value."""
    values = [c for c in metrics.columns if c not in ids]
    typed = metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return typed.unpivot(list(ids), values, "metric_name", "metric_value")


def objective_breakdown(
    schedule: DataFrame, batteries: DataFrame, by: Sequence[str] = ("dispatch_run_id",), *, hours: float = 1.0,
    peak: float = 1.0, energy_cost: float = 1.0, renewable_utilization: float = 0.5, degradation: float = 1.0,
    terminal_soc: float = 10.0,
) -> DataFrame:
    """Objective terms of a schedule and their weighted contributions."""
    rows = schedule.join(batteries.select("battery_id", "terminal_soc_target_mwh"), "battery_id")
    after, c, x = F.col("net_load_after_battery_mw"), F.col("charge_mw"), F.col("discharge_mw")
    terms = rows.groupBy(*by).agg(
        F.max(after).alias("peak_load_mw"),
        F.sum(after * F.col("energy_price") * hours).alias("energy_cost"),
        F.sum(c * renewable_share() * hours).alias("renewable_aligned_charge_mwh"),
        F.sum((c + x) * F.col("marginal_degradation_cost") * hours).alias("degradation_cost"),
        F.abs(F.max_by("soc_end_mwh", "timestamp_utc") - F.max("terminal_soc_target_mwh")).alias("terminal_soc_deviation_mwh"),
    )
    return terms.withColumns(
        {
            "weighted_peak_contribution": F.col("peak_load_mw") * peak,
            "weighted_energy_cost_contribution": F.col("energy_cost") * energy_cost,
            "weighted_renewable_utilization_contribution": F.col("renewable_aligned_charge_mwh") * -renewable_utilization,
            "weighted_degradation_contribution": F.col("degradation_cost") * degradation,
            "weighted_terminal_soc_contribution": F.col("terminal_soc_deviation_mwh") * terminal_soc,
        }
    )


def run_headers(schedule: DataFrame, by: Sequence[str] = ("dispatch_run_id", "region", "battery_id"), hours: float = 1.0) -> DataFrame:
    """Peaks and energy totals of a run."""
    return schedule.groupBy(*by).agg(
        F.max("net_load_before_battery_mw").alias("peak_before_mw"),
        F.max("net_load_after_battery_mw").alias("peak_after_mw"),
        (F.sum("charge_mw") * hours).alias("total_charge_mwh"),
        (F.sum("discharge_mw") * hours).alias("total_discharge_mwh"),
    )
