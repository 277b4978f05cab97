"""Runs that stay below an anchor, over ordered stretches of any length.

A run starts at a row far enough below the row before it, whose value becomes the anchor; it lasts while values stay as far
below that anchor, and the next run may start where it ended. What a row does therefore depends on whether a run is open and on
its anchor. A part of a stretch is summarised as a function of that: for an open run, the first row that ends it is where the
values first exceed all before them and the anchor allows no more, so one entry per such record, and one for no open run, say
which run is open behind the part. These functions compose associatively. Parts meet ``fan`` at a time, level by level; the run
that is open before each part comes back down, and rows are then folded inside their part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (start, first value, anchor, rows) of an open run; times are microseconds.
Run = tuple[int, float, float, int]
RUN = "struct<start:bigint,first:double,anchor:double,n:bigint>"
_SUMMARY = f"_part long, _records array<double>, _behind array<{RUN}>, _none {RUN}, _size long"
_FIELDS = ("start", "first", "anchor", "n")


@dataclass(frozen=True)
class Fall:
    """A value is low below an anchor by ``drop`` and by the ``share`` of it; anchors reach ``expected``."""

    expected: float
    drop: float
    share: float

    def low(self, anchor: float | None, value: float | None) -> bool:
        if anchor is None or value is None or math.isnan(anchor) or math.isnan(value) or anchor == 0:
            return False
        below = anchor - value
        part = below / abs(anchor)
        # undefined differences of infinities count as large, as they do in SQL
        return not (below < self.drop or part < self.share)


@dataclass
class Summary:
    """What a part does to an open run: ``behind[i]`` is open behind it if ``records[i]`` is the first that ends the run.

    Records grow; a last one of None, a missing value, ends any run.
    """

    records: list[float | None]
    behind: list[Run | None]
    none: Run | None
    size: int

    def after(self, run: Run | None, fall: Fall) -> Run | None:
        """The run that is open behind the part if ``run`` is open before it."""
        if run is None:
            return self.none
        for record, behind in zip(self.records, self.behind, strict=True):
            if not fall.low(run[2], record):
                return behind
        return (*run[:3], run[3] + self.size)


def summarise(times: list[int], values: list[float | None], before: float | None, fall: Fall) -> Summary:
    """A part's rows in order; ``before`` is the value of the row before it."""
    prior = [before, *values[:-1]]
    open_from: list[Run | None] = [None] * (len(values) + 1)  # run open at the end if none is open before row i
    for i in range(len(values) - 1, -1, -1):
        anchor = prior[i]
        if anchor is None or anchor < fall.expected or not fall.low(anchor, values[i]):
            open_from[i] = open_from[i + 1]
            continue
        j = i + 1
        while j < len(values) and fall.low(anchor, values[j]):
            j += 1
        open_from[i] = (times[i], values[i], anchor, j - i) if j == len(values) else open_from[j]
    records, behind = [], []
    for i, value in enumerate(values):
        if value is None or math.isnan(value):
            records.append(None)
            behind.append(open_from[i])
            break
        if not records or value > records[-1]:
            records.append(value)
            behind.append(open_from[i])
    return Summary(records, behind, open_from[0], len(values))


def composed(f: Summary, g: Summary, fall: Fall) -> Summary:
    """First ``f``, then ``g``."""
    records, behind = list(f.records), [g.after(run, fall) for run in f.behind]
    top = records[-1] if records else -math.inf
    for record, run in zip(g.records, g.behind, strict=True) if top is not None else ():
        if record is None or record > top:  # what passed through f ends here at the earliest
            records.append(record)
            behind.append(run)
    return Summary(records, behind, g.after(f.none, fall), f.size + g.size)


def _struct(run: Run | None) -> dict | None:
    return None if run is None else dict(zip(_FIELDS, run, strict=True))


def _run(struct: dict | None) -> Run | None:
    return None if struct is None else tuple(struct[f] for f in _FIELDS)


def _summary(row: dict) -> Summary:
    return Summary(row["_records"], [_run(r) for r in row["_behind"]], _run(row["_none"]), row["_size"])


def _columns(summary: Summary) -> dict:
    return {"_records": summary.records, "_behind": [_struct(r) for r in summary.behind], "_none": _struct(summary.none), "_size": summary.size}


def open_before(parts: DataFrame, keys: list[str], fall: Fall, fan: int = 1000, levels: int = 1) -> DataFrame:
    """(keys, _part, _open): the run that is open before each part of a stretch, null if none.

    ``parts`` has a row per keys and ``_part`` (a number that grows along the stretch): ``_rows`` array<struct<t, v>> in order
    and ``_before``, the value of the row before the part, null for the first one, whose first row only serves as such.
    With more than one level, ``fan`` neighbouring parts are composed into one first, and so on; a task holds the
    summaries of ``fan`` parts or, on the top level, those of a stretch.
    """
    types = dict(parts.dtypes)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def summaries(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = row["_rows"]
                times, values, before = [r["t"] for r in rows], [r["v"] for r in rows], row["_before"]
                if row["_head"]:
                    times, values, before = times[1:], values[1:], values[0]
                out.append({**{k: row[k] for k in keys}, "_part": row["_part"], **_columns(summarise(times, values, before, fall))})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(batch.schema, keys))

    rows = parts.select(*keys, "_part", F.transform("_rows", lambda r: F.struct(F.unix_micros(r["t"]).alias("t"), r["v"].cast("double").alias("v"))).alias("_rows"),
                        F.col("_before").cast("double").alias("_before"), "_head")
    made = rows.mapInArrow(summaries, f"{key_schema}, {_SUMMARY}")
    return _entries(made, keys, fall, fan, levels, key_schema)


_STRUCT = pa.struct([("start", pa.int64()), ("first", pa.float64()), ("anchor", pa.float64()), ("n", pa.int64())])


def _arrow(schema: pa.Schema, keys: list[str], *more: pa.Field) -> pa.Schema:
    summary = [
        pa.field("_part", pa.int64()), pa.field("_records", pa.list_(pa.float64())), pa.field("_behind", pa.list_(_STRUCT)),
        pa.field("_none", _STRUCT), pa.field("_size", pa.int64()),
    ]
    return pa.schema([*(schema.field(k) for k in keys), *summary, *more])


def _entries(made: DataFrame, keys: list[str], fall: Fall, fan: int, levels: int, key_schema: str) -> DataFrame:
    """Carry open runs through neighbouring summaries, those of the level above first."""

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_part"])
        whole = _summary(rows[0])
        for row in rows[1:]:
            whole = composed(whole, _summary(row), fall)
        out = {**{k: rows[0][k] for k in keys}, "_part": rows[0]["_up"], **_columns(whole)}
        return pa.Table.from_pylist([out], schema=_arrow(table.schema, keys))

    def carry(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_part"])
        run, out = _run(rows[0].get("_open")), []
        for row in rows:
            out.append({**{k: row[k] for k in keys}, "_part": row["_part"], "_open": _struct(run)})
            run = _summary(row).after(run, fall)
        fields = [*(table.schema.field(k) for k in keys), pa.field("_part", pa.int64()), pa.field("_open", _STRUCT)]
        return pa.Table.from_pylist(out, schema=pa.schema(fields))

    result = f"{key_schema}, _part long, _open {RUN}"
    if levels == 1:
        return made.groupBy(*keys).applyInArrow(carry, result)
    lifted = made.withColumn("_up", F.floor(F.col("_part") / fan).cast("long"))
    coarser = lifted.groupBy(*keys, "_up").applyInArrow(compose, f"{key_schema}, {_SUMMARY}")
    above = _entries(coarser, keys, fall, fan, levels - 1, key_schema).withColumnRenamed("_part", "_up")
    return lifted.join(above, [*keys, "_up"]).groupBy(*keys, "_up").applyInArrow(carry, result)
