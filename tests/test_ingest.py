"""Pages, cleaning, contracts and stored tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from kilohour import contracts
from kilohour.errors import ConflictingDuplicates, ContractViolation, NotFound, StorageConflict
from kilohour.functions.text import redact
from kilohour.operators import clean, weather
from kilohour.plans import jobs
from kilohour.sources import pages, tables

NOW = "2024-02-01"


def now():
    return F.lit(NOW).cast("timestamp")


def page(records, total=None):
    return json.dumps({"response": {"total": str(total or len(records)), "data": records}, "request": {"command": "x"}})


def rec(period, kind, value, region="PJM", name=None):
    return {"period": period, "respondent": region, "type": kind, "type-name": name, "value": value}


def land(tmp_path, *texts):
    folder = tmp_path / "landed"
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"page{i}.json").write_text(text)
    return str(folder)


def hours(n=3, regions=("PJM",)):
    return [rec(f"2024-01-01T{h:02d}", k, str(v + h), r) for r in regions for h in range(n) for k, v in (("D", 100), ("DF", 90), ("NG", 80), ("TI", -5))]


def test_ingest_job_is_idempotent_and_reconciles(spark, tmp_path):
    landed = land(tmp_path, page(hours(3)), page([rec("2024-01-01T03", None, "7", name="Demand")]))
    table = str(tmp_path / "table")
    for _ in range(2):
        out = jobs.ingest_measurements(spark, landed, table, start="2024-01-01", end="2024-01-01", ingested_at=now())
    assert out.retained.count() == 4 and tables.read_table(spark, table).count() == 4
    report = out.reconciliation.first()
    assert (report["unexplained_difference"], report["missing_source_timestamp_rows"]) == (0, 20)
    assert jobs.revalidate(spark, table).first()["row_count"] == 4


def test_missing_demand_policy(spark, tmp_path):
    landed = land(tmp_path, page(hours(2) + [rec("2024-01-01T02", "D", None), rec("2024-01-01T02", "NG", "1")]))
    args = dict(start="2024-01-01", end="2024-01-01", ingested_at=now())
    with pytest.raises(ContractViolation):
        jobs.ingest_measurements(spark, landed, str(tmp_path / "t"), **args)
    bad = str(tmp_path / "bad")
    jobs.ingest_measurements(spark, landed, str(tmp_path / "t"), policy="drop", quarantine=bad, **args)
    assert spark.read.parquet(bad).count() == 1


def test_conflicting_values_fail_and_missing_counts_as_a_value(spark, tmp_path):
    for other in ("11", None):
        records = spark.createDataFrame(
            [("2024-01-01T00", "PJM", "D", None, "10"), ("2024-01-01T00", "PJM", "d", None, other)],
            "period string, respondent string, type string, type_name string, value string",
        )
        with pytest.raises(ConflictingDuplicates):
            clean.prepare_measurements(records, now())


def test_bad_number_stops_a_strict_read(spark):
    rows = spark.createDataFrame([("2024-01-01T00", "PJM", "D", "many")], "timestamp string, region string, measurement_type string, value string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.mapped_measurements(rows).collect()
    assert clean.mapped_measurements(rows, strict=False).first()["value"] is None


def test_fuel_rows_quarantine_negatives(spark):
    records = spark.createDataFrame(
        [
            ("2024-01-01T00", "PJM", "SUN", None, None, "10"), ("2024-01-01T00", "PJM", "WND", None, None, "20"),
            ("2024-01-01T01", "PJM", None, None, "solar", "11"), ("2024-01-01T02", "PJM", "WND", None, None, "-1"),
        ],
        "period string, respondent string, fueltype string, type string, type_name string, value string",
    )
    valid, bad = clean.split_renewables(records, now())
    rows = {str(r["timestamp_utc"])[11:13]: r for r in valid.collect()}
    assert bad.count() == 1 and set(rows) == {"00", "01"}
    assert rows["00"]["total_renewable_generation_mw"] == 30
    assert rows["01"]["wind_generation_mw"] is None and rows["01"]["total_renewable_generation_mw"] is None


def test_page_without_records_is_an_error(spark, tmp_path):
    parsed = pages.parse_pages(pages.read_page_texts(spark, land(tmp_path, '{"response": {"total": "1"}}')))
    with pytest.raises(ContractViolation):
        pages.page_records(parsed)


def weather_page(value, direction):
    names = list(pages.WEATHER_FIELDS)
    hourly = {n: [value, value] for n in names} | {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wind_direction_10m": [direction] * 2}
    return json.dumps({"latitude": 40.0, "longitude": -75.0, "hourly": hourly})


def test_weather_payload_to_circular_mean(spark):
    texts = spark.createDataFrame(
        [("PJM", "a", "p1", weather_page(10, 350)), ("PJM", "b", "p2", weather_page(11, 10))],
        "region string, location_name string, page string, value string",
    )
    places = pages.region_locations(
        spark.createDataFrame([("PJM", "a", 40.0, -75.0, 2.0), ("PJM", "b", 41.0, -76.0, 1.0)],
                              "region string, location_name string, latitude double, longitude double, location_weight double")
    )
    good, bad = pages.split_weather_pages(pages.parse_pages(texts, pages.WEATHER_SCHEMA))
    rows = pages.weather_rows(good, places, "historical", now(), "landed")
    contracts.location_weather().enforce(rows)
    assert bad.count() == 0 and rows.count() == 4
    out = weather.regional_weather(rows, places).first()
    assert out["wind_direction_10m_deg"] > 350
    assert out["temperature_c"] == pytest.approx(31 / 3)
    with pytest.raises(ContractViolation):
        weather.regional_weather(rows.where("location_name = 'a'"), places)


def test_upsert_touches_only_its_months(spark, tmp_path, frame):
    path = str(tmp_path / "t")
    columns = "timestamp_utc string, region string, demand_mw double, forecast_demand_mw double, net_generation_mw double, total_interchange_mw double, ingestion_timestamp_utc string"
    row = lambda t, v: (t, "PJM", v, None, None, None, NOW)
    tables.upsert_table(spark, path, frame([row("2024-01-01 00:00:00", 1.0), row("2024-02-01 00:00:00", 2.0)], columns), contracts.GRID_KEY)
    before = {f.name for f in (tmp_path / "t" / "region=PJM" / "year=2024" / "month=1").glob("*.parquet")}
    tables.upsert_table(spark, path, frame([row("2024-02-01 00:00:00", 5.0), row("2024-02-01 01:00:00", 6.0)], columns), contracts.GRID_KEY)
    after = {f.name for f in (tmp_path / "t" / "region=PJM" / "year=2024" / "month=1").glob("*.parquet")}
    assert before == after
    assert sorted(r["demand_mw"] for r in tables.read_table(spark, path).collect()) == [1.0, 5.0, 6.0]
    assert not list(tmp_path.glob("*staging*"))
    # a batch without a stored column would empty it in the months it touches
    with pytest.raises(StorageConflict, match="net_generation_mw"):
        tables.upsert_table(spark, path, frame([row("2024-02-01 00:00:00", 5.0)], columns).drop("net_generation_mw"), contracts.GRID_KEY)
    stored = spark.read.parquet(path)
    plan = tables.months(stored, tables.with_partitions(frame([row("2024-02-01 00:00:00", 5.0)], columns)))._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[[^\]]*", plan)[0]
    assert "2024" in filters and "month" in filters


def test_read_rejects_rows_in_a_wrong_folder(spark, tmp_path, frame):
    path = tmp_path / "t"
    columns = "timestamp_utc string, demand_mw double"
    frame([("2024-03-01 00:00:00", 1.0)], columns).write.parquet(str(path / "region=PJM" / "year=2024" / "month=1"))
    with pytest.raises(StorageConflict):
        tables.check_table(spark, str(path))
    assert tables.read_table(spark, str(tmp_path / "absent")).count() == 0


def test_write_runs_replaces_only_its_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    tables.write_runs(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "run string, v int"), path, "run")
    tables.write_runs(spark.createDataFrame([("a", 9)], "run string, v int"), path, "run")
    assert sorted((r["run"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_contract_lists_all_failures(spark, frame):
    rows = frame([("2024-01-01 00:00:00", "PJM", -1.0), ("2024-01-01 00:00:00", "PJM", None)], "timestamp_utc string, region string, demand_mw double")
    for c in ("forecast_demand_mw", "net_generation_mw", "total_interchange_mw"):
        rows = rows.withColumn(c, F.lit(None).cast("double"))
    rows = rows.withColumn("ingestion_timestamp_utc", now())
    with pytest.raises(ContractViolation, match="demand_mw_not_negative=1, demand_mw_present=1, unique_key=1"):
        contracts.canonical_grid().enforce(rows)
    with pytest.raises(ContractViolation, match="unknown"):
        contracts.canonical_grid().enforce(rows.withColumn("other", F.lit(1)))


def test_secrets_never_land(spark, tmp_path):
    body = '{"url": "https://x?api_key=abc&y=1", "api_key": "abc", "echo": "a b/c a%20b%2Fc a+b%2Fc"}'
    texts = spark.createDataFrame([(body,)], "value string")
    tables.write_raw_pages(texts, str(tmp_path / "raw"), ("a b/c",))
    landed = spark.read.text(str(tmp_path / "raw")).first()[0]
    assert "abc" not in landed and "b/c" not in landed and "%2Fc" not in landed and '"y' not in landed
    assert texts.select(redact(F.col("value"))).first()[0].count("[REDACTED]") == 2


def test_point_lookup_of_an_absent_id(spark):
    with pytest.raises(NotFound):
        tables.by_id(spark.range(3), "id", 9)
