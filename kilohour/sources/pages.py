"""Landed JSON pages to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilohour.contracts import LOCATION_WEATHER_COLUMNS
from kilohour.errors import ContractViolation
from kilohour.functions.time import parse_period

_RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("period", "respondent", "fueltype", "type", "type-name", "value")]
)
PAGE_SCHEMA = T.StructType(
    [
        T.StructField(
            "response",
            T.StructType([T.StructField("total", T.StringType()), T.StructField("data", T.ArrayType(_RECORD))]),
        )
    ]
)

# Provider field names and ours.
WEATHER_FIELDS = {
    "temperature_2m": "temperature_c",
    "apparent_temperature": "apparent_temperature_c",
    "relative_humidity_2m": "relative_humidity_pct",
    "precipitation": "precipitation_mm",
    "cloud_cover": "cloud_cover_pct",
    "wind_speed_10m": "wind_speed_10m_kph",
    "wind_direction_10m": "wind_direction_10m_deg",
    "shortwave_radiation": "shortwave_radiation_wm2",
    "direct_radiation": "direct_radiation_wm2",
    "diffuse_radiation": "diffuse_radiation_wm2",
}
WEATHER_SCHEMA = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(name, T.ArrayType(T.StringType())) for name in WEATHER_FIELDS]
            ),
        ),
    ]
)


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: ``page`` (its path) and ``value`` (its text)."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("page"), "value")


def parse_pages(texts: DataFrame, schema: T.StructType = PAGE_SCHEMA) -> DataFrame:
    """Typed pages; ``_corrupt`` keeps text that does not parse."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return texts.withColumn("_page", F.from_json("value", full, options)).select("*", "_page.*").drop("_page", "value")


def page_records(pages: DataFrame) -> DataFrame:
    """All records of all pages with an arrival sequence of page and position."""
    broken = pages.where(F.col("response.data").isNull()).limit(3).select("page").collect()
    if broken:
        raise ContractViolation(f"pages without a list of records: {[r[0] for r in broken]}")
    return pages.select("page", F.posexplode("response.data").alias("_at", "r")).select(
        "page",
        F.col("r.period").alias("period"),
        F.col("r.respondent").alias("respondent"),
        F.col("r.fueltype").alias("fueltype"),
        F.col("r.type").alias("type"),
        F.col("r")["type-name"].alias("type_name"),
        F.col("r.value").alias("value"),
        F.format_string("%s#%09d", F.col("page"), F.col("_at")).alias("_ingest_seq"),
    )


def page_completeness(pages: DataFrame, request: Column) -> DataFrame:
    """Per request: records received against the announced total."""
    report = pages.groupBy(request.alias("request")).agg(
        F.coalesce(F.sum(F.size("response.data")), F.lit(0)).alias("received"),
        F.coalesce(F.max(F.col("response.total").try_cast("bigint")), F.lit(0)).alias("announced"),
    )
    return report.withColumn("complete", F.col("received") >= F.col("announced"))


def split_weather_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages whose ten arrays match the length of ``time``, and the others."""
    good = F.col("hourly.time").isNotNull()
    for name in WEATHER_FIELDS:
        good = good & F.coalesce(F.size(F.col(f"hourly.{name}")) == F.size("hourly.time"), F.lit(False))
    return pages.where(good), pages.where(~good)


def weather_rows(pages: DataFrame, locations: DataFrame, data_type: str, ingested_at: Column, source: str) -> DataFrame:
    """Parallel arrays to location rows. Pages carry ``region`` and ``location_name``.

    Coordinates of the page win over those of the location table.
    """
    zipped = F.arrays_zip("hourly.time", *[F.col(f"hourly.{name}") for name in WEATHER_FIELDS])
    rows = pages.select("region", "location_name", "latitude", "longitude", F.explode(zipped).alias("h"))
    known = locations.select(
        "region", "location_name", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "location_weight"
    )
    values = {
        ours: F.nanvl(F.col(f"h.{theirs}").try_cast("double"), F.lit(None).cast("double"))
        for theirs, ours in WEATHER_FIELDS.items()
    }
    return (
        rows.join(known, ["region", "location_name"])
        .withColumns(values)
        .withColumns(
            {
                "timestamp_utc": parse_period(F.col("h.time")),
                "latitude": F.coalesce("latitude", "_lat"),
                "longitude": F.coalesce("longitude", "_lon"),
                "ingestion_timestamp_utc": ingested_at,
                "data_source": F.lit(source),
                "weather_data_type": F.lit(data_type),
            }
        )
        .select(*LOCATION_WEATHER_COLUMNS)
    )


def region_locations(rows: DataFrame, aggregation: str = "weighted_mean") -> DataFrame:
    """Location dimension with unique names and weights that sum to one per region."""
    from kilohour.operators.joins import require_unique

    if aggregation != "weighted_mean":
        raise ContractViolation(f"unsupported aggregation {aggregation}")
    require_unique(rows, ["region", "location_name"], "location table")
    if not rows.where(~F.coalesce(F.col("location_weight") > 0, F.lit(False))).isEmpty():
        raise ContractViolation("location weights must be positive")
    totals = rows.groupBy("region").agg(F.sum("location_weight").alias("_total"))
    return (
        rows.join(totals, "region").withColumn("location_weight", F.col("location_weight") / F.col("_total")).drop("_total")
    )
