"""What a time series is: entity columns, a time column, a value column and a step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesSpec:
    """Names and step of a series.

    ``chunk_rows`` is the number of grid steps one task works on. Ordered operators split every
    entity into chunks of that size, so that an entity holding a third of all rows still spreads
    over many tasks.
    """

    entity: tuple[str, ...] = ("region",)
    time: str = "timestamp_utc"
    value: str = "demand_mw"
    step_seconds: int = 3600
    chunk_rows: int = 4096

    @property
    def key(self) -> list[str]:
        return [*self.entity, self.time]

    @property
    def step_us(self) -> int:
        return self.step_seconds * 1_000_000

    def grid(self, column: Column | str | None = None) -> Column:
        """Number of whole steps since the epoch."""
        stamp = F.col(self.time) if column is None else _col(column)
        return F.floor(F.unix_micros(stamp) / F.lit(self.step_us)).cast("long")

    def chunk(self) -> Column:
        return F.floor(self.grid() / F.lit(self.chunk_rows)).cast("long")

    def shift(self, column: Column | str, steps: Column | int) -> Column:
        """Timestamp moved by a number of steps."""
        amount = F.lit(steps) if isinstance(steps, int) else steps
        return F.timestamp_micros(F.unix_micros(_col(column)) + amount * F.lit(self.step_us))

    def steps_between(self, earlier: Column, later: Column) -> Column:
        """Distance in steps, as a double."""
        return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(self.step_us))


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


HOURLY = SeriesSpec()
