"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.tables import drop_folder, write_table
from tidewire.tables import written as materialize  # noqa: F401

#: Rows and bytes of one Arrow batch: documents may hold 100 kB each, so the default of 10,000 rows is too many.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile leave no shuffle files, which else stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Written tables of one computation, deleted when nothing will read them again."""

    def __init__(self, paths: dict[int, tuple[DataFrame, str]] | None = None):
        self.all: dict[int, tuple[DataFrame, str]] = {} if paths is None else paths
        self.own: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out, path = write_table(df, name)
        self.all[id(out)] = (out, path)
        return out

    def inner(self) -> Scratch:
        """For tables that a part of the computation alone reads: add() them here, and drop() them."""
        return Scratch(self.all)

    def add(self, df: DataFrame) -> DataFrame:
        self.own.append(df)
        return df

    def drop(self) -> None:
        """Delete the added tables."""
        for df in self.own:
            drop_folder(df.sparkSession, self.all.pop(id(df))[1])
        self.own = []

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but these."""
        self.own = [df for df, _ in self.all.values() if not any(df is k for k in kept)]
        self.drop()


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_rows(
    df: DataFrame, columns: Iterable[str], make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]], schema: T.StructType
) -> DataFrame:
    """mapInArrow over some columns; make() runs once a task and returns the function of a batch."""
    small_batches(df.sparkSession)
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    flat = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in t])
    return flat[t.simpleString()]


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    at = batch.schema.get_field_index(column)
    return [b or b"" for b in batch.column(at).cast(pa.binary()).to_pylist()]


def str_texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [s or "" for s in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast a side that was counted: beyond `most` rows the join shuffles both sides instead."""
    return F.broadcast(df) if rows <= most else df


def sql_text(pattern: str) -> str:
    return re.sub(r"\s+", " ", pattern).strip()
