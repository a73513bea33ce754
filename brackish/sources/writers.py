"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from brackish.sources.readers import MISSING


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Delimited text with a header, missing values as NA, in the given order."""
    out = df.orderBy(*order) if order else df
    out.write.mode(mode).option("header", True).option("nullValue", MISSING).option("emptyValue", "").csv(path)


def write_and_continue(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Write the table and go on with what was written, so that it is computed once."""
    write_table(df, path, order, mode)
    reader = df.sparkSession.read.option("header", True).option("nullValue", MISSING)
    return reader.schema(df.schema).csv(path)


def write_observations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet in one folder per survey."""
    df.write.mode(mode).partitionBy("source").parquet(path)
