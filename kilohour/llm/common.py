"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilohour.session import cut_lineage, shared_folder

# White space as the contracts count it, U+0020 and U+0009 to U+000D.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder; readers survive lost executors."""
    return cut_lineage(df)


def shared_name(spark: SparkSession, what: str) -> str:
    """A folder of its own inside the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        delete(df.sparkSession, files[0].rpartition("/")[0])


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column | str) -> Column:
    """Rows that no training step may see: crc32 of the id as text leaves remainder 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def unmade(columns: list[str], made: Iterable[str]) -> list[str]:
    """The columns but those with a name that an operator makes: the made ones replace them, whatever their case."""
    names = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in names]


def free(name: str, columns: Iterable[str]) -> str:
    """The name, lengthened until no column has it."""
    names = {c.lower() for c in columns}
    while name.lower() in names:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as Spark reads it in a select or a schema, dots and quotes included."""
    return "`" + name.replace("`", "``") + "`"


def placed(columns: list[str]) -> list[Column]:
    """The columns named by place, c0 and on: Spark cannot hand names with dots or quotes to Arrow tasks."""
    return [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]


def raw(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes, whether or not they decode."""
    return column.cast(pa.binary()).to_pylist()


def decoded(column: pa.Array) -> list[str]:
    """Texts; null counts as empty, and bytes that are no UTF-8 become the replacement character."""
    return [t.decode("utf-8", "replace") if t else "" for t in raw(column)]


def sized_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose texts take about ``most`` bytes at most; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
