"""Small helpers that the operators share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.session import fresh_path, settle

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about ``most`` bytes, so that work arrays stay small.

    A single longer value comes alone.
    """
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(
    df: DataFrame, keep: list[str], text: str, work: Callable[[list[str]], list[dict]], schema: str
) -> DataFrame:
    """One output row for each row: the columns ``keep``, then what ``work`` returns for the texts ('' for null)."""
    names = [c for c, _ in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = work(["" if t is None else t for t in batch.column("__text").to_pylist()])
                made = [pa.array([row[c] for row in found]) for c in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    return source.mapInArrow(_typed(run, f"{kept}, {schema}", keep, names), f"{kept}, {schema}")


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in schema.split(", ")]


def _typed(run, schema: str, keep: list[str], names: list[str]):
    """``run`` with its batches cast to the Arrow types of ``schema``."""
    arrow = {
        "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }
    types = {c: arrow.get(kind) for c, kind in _fields(schema.replace("`", ""))}

    def cast(batches):
        for batch in run(batches):
            columns = [
                batch.column(c).cast(types[c]) if c in names and types[c] is not None else batch.column(c)
                for c in batch.schema.names
            ]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return cast


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


__all__ = ["fresh_path", "map_texts", "settle", "sha256", "slices", "table", "uuid"]
