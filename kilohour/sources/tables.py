"""Stored tables: reading, keyed merging and replacing on plain Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilohour.errors import NotFound, StorageConflict
from kilohour.functions.ordered import keep_last
from kilohour.functions.text import redact

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("timestamp_utc", T.TimestampType()),
        T.StructField("region", T.StringType()),
        T.StructField("demand_mw", T.DoubleType()),
        T.StructField("forecast_demand_mw", T.DoubleType()),
        T.StructField("net_generation_mw", T.DoubleType()),
        T.StructField("total_interchange_mw", T.DoubleType()),
        T.StructField("ingestion_timestamp_utc", T.TimestampType()),
    ]
)
PARTITIONS = ("region", "year", "month")


def empty_table(spark: SparkSession, schema: T.StructType = CANONICAL_SCHEMA) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_partitions(df: DataFrame, time: str = "timestamp_utc") -> DataFrame:
    return df.withColumn("year", F.year(time)).withColumn("month", F.month(time))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, path: str, schema: T.StructType = CANONICAL_SCHEMA) -> DataFrame:
    """A table partitioned by region, year and month, in its fixed schema; absent means empty.

    Nothing is scanned here, so later filters still prune months and columns; ``check_table`` validates.
    """
    if not exists(spark, path):
        return empty_table(spark, schema)
    full = T.StructType(
        [*schema.fields, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]
    )
    rows = spark.read.schema(full).option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.select(*[f.name for f in schema.fields])


def check_table(spark: SparkSession, path: str, time: str = "timestamp_utc") -> None:
    """Rows whose time does not belong to their folder are an error; reads the time and the folders only."""
    if not exists(spark, path):
        return
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path).select(time, "year", "month")
    if not rows.where((F.year(time) != F.col("year")) | (F.month(time) != F.col("month"))).isEmpty():
        raise StorageConflict(f"{path}: rows lie in a folder of another month")


def merge_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], precedence: Sequence[str] = ()) -> DataFrame:
    """Keyed upsert: incoming rows replace existing ones; the batch itself is reduced to one row per key."""
    batch = keep_last(incoming.select(*existing.columns), list(keys), list(precedence))
    untouched = existing.join(batch.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(batch)


def append_absent(existing: DataFrame, incoming: DataFrame, identifier: str) -> DataFrame:
    """Rows of the batch whose id is not stored yet."""
    fresh = keep_last(incoming, [identifier], [])
    return fresh.join(existing.select(identifier), identifier, "left_anti")


def replace_runs(existing: DataFrame, incoming: DataFrame, run: str) -> DataFrame:
    """All rows of the incoming runs replace all stored rows of those runs."""
    runs = incoming.select(run).distinct()
    return existing.join(runs, run, "left_anti").unionByName(incoming.select(*existing.columns))


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], precedence: Sequence[str] = ()) -> int:
    """Merge a batch into a month-partitioned table; returns the rows of the touched months.

    Only months the batch touches are read and rewritten: they are few, so their names go into the plan as literal
    partition filters. The stored table's columns are kept: a batch with other columns is refused, because a column it
    lacks would be lost in every month it touches. The merged months are written beside the table once, counted and
    hashed on the way, compared with what can be read back, and then put in place by dynamic partition overwrite. One
    writer at a time.
    """
    names = [f.name for f in incoming.schema.fields if f.name not in ("year", "month")]
    batch = with_partitions(incoming.select(*names))
    if exists(spark, path):
        stored = spark.read.option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(path)
        held = {f.name: f.dataType for f in stored.schema.fields}
        given = {f.name: f.dataType for f in batch.schema.fields}
        if held.keys() != given.keys():
            raise StorageConflict(f"{path}: columns differ from the stored ones: {sorted(held.keys() ^ given.keys())}")
        stored = months(stored, batch).select(*[F.col(n).cast(given[n]).alias(n) for n in batch.columns])
    else:
        stored = empty_table(spark, batch.schema)
    merged = merge_rows(stored, batch, keys, precedence)
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    seen = Observation()
    try:
        _write_partitioned(merged.observe(seen, *_digest_columns(merged)), staging, PARTITIONS)
        staged = spark.read.schema(merged.schema).parquet(staging)
        wanted, written = tuple(seen.get.values()), tuple(staged.agg(*_digest_columns(staged)).first())
        if wanted != written:
            raise StorageConflict(f"{path}: staged rows differ from the merged rows {wanted} != {written}")
        _write_partitioned(staged, path, PARTITIONS, dynamic=True)
        return int(written[0])
    finally:
        _delete(spark, staging)


def months(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows of the batch's months and regions; months are literals, so the scan lists only their folders."""
    touched = [(r["year"], r["month"]) for r in batch.select("year", "month").distinct().collect()]  # a row per month
    wanted = F.lit(False)
    for year in sorted({y for y, _ in touched if y is not None}):
        wanted = wanted | ((F.col("year") == year) & F.col("month").isin([m for y, m in touched if y == year]))
    return stored.where(wanted).join(batch.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi")


def _write_partitioned(df: DataFrame, path: str, partitions: Sequence[str], dynamic: bool = False) -> None:
    # rebalancing splits a month that holds very many rows over several tasks and joins small ones
    writer = df.hint("rebalance", *partitions).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*partitions).parquet(path)


def _digest_columns(df: DataFrame) -> list[Column]:
    names = sorted(df.columns)
    wide = F.sum(F.xxhash64(*[F.col(n) for n in names]).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("rows"), wide.alias("hash")]


def write_runs(df: DataFrame, path: str, run: str) -> None:
    """Replace the stored rows of the frame's runs: one folder per run, dynamic overwrite."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(run).parquet(path)


def write_raw_pages(texts: DataFrame, path: str, secrets: tuple[str, ...] = ()) -> None:
    """Land page texts with credentials removed."""
    texts.select(redact(F.col("value"), secrets).alias("value")).write.mode("append").text(path)


def write_quarantine(rows: DataFrame, path: str, reason: str, run_id: str) -> None:
    rows.withColumn("reason", F.lit(reason)).withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def report_json(report: DataFrame) -> DataFrame:
    """Report rows as JSON text; NaN and infinity become null."""
    out = []
    for f in report.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        out.append(c.alias(f.name))
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'"}
    return report.select(F.to_json(F.struct(*out), options).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report_json(report).write.mode("overwrite").text(path)


def read_range(
    table: DataFrame,
    *,
    regions: Sequence[str] | None = None,
    start: object = None,
    end: object = None,
    equal: Mapping[str, object] | None = None,
    order_by: Sequence[str] = ("region", "timestamp_utc"),
    time: str = "timestamp_utc",
) -> DataFrame:
    """Inclusive range read with optional equality filters; every filter can reach the scan."""
    out = table
    if regions is not None:
        out = out.where(F.col("region").isin(list(regions)))
    out = filtered(out, equal or {})
    if start is not None:
        out = out.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return out.orderBy(*order_by)


def filtered(df: DataFrame, equal: Mapping[str, object]) -> DataFrame:
    """Equality filters; a value of None means no filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def by_id(df: DataFrame, identifier: str, value: object) -> DataFrame:
    found = df.where(F.col(identifier) == F.lit(value)).limit(1)
    if found.isEmpty():
        raise NotFound(f"{identifier} {value} was not found")
    return found


def json_records(df: DataFrame) -> DataFrame:
    """Rows as JSON text with UTC instants and explicit nulls; ``*_json`` columns are decoded."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name.endswith("_json"):
            out.append(F.try_parse_json(c).alias(f.name.removesuffix("_json")))
        elif isinstance(f.dataType, T.DoubleType):
            out.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            out.append(c.alias(f.name))
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'"}
    return df.select(F.to_json(F.struct(*out), options).alias("record"))


def export_artifacts(path: str, *, frames: Mapping[str, DataFrame], tables_csv: Mapping[str, DataFrame] | None = None) -> None:
    """Result frames as Parquet and metric tables as CSV under one folder."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, df in (tables_csv or {}).items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def read_leaderboard(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
