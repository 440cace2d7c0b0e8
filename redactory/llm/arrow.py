"""Shared pieces of the Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from redactory.session import ship_package

#: Rows and bytes of an Arrow batch. Whole texts travel in these batches, so the library's 10,000 rows could be gigabytes.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds the Arrow batches of this session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts_of(column) -> Iterator[str]:
    """Python strings of an Arrow string column, null as empty."""
    for x in column.to_pylist():
        yield x if x is not None else ""
