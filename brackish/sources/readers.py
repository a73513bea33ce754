"""Table sources: delimited text, Parquet, partitioned surveys."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "NA"  # fixed value: how text tables write a missing value

# The long-term surveys.
SURVEYS = ("EMP", "STN", "FMWT", "DJFMP", "SKT", "20mm", "Suisun", "Baystudy", "USGS")
PLANKTON_SURVEYS = ("EMP", "STN", "20mm", "FMWT")


def read_table(
    spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Delimited text with a header. Without a schema types are inferred from the whole file.

    A byte-order mark is skipped; ``columns`` prunes what is parsed.
    """
    reader = spark.read.option("header", True).option("nullValue", MISSING)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    table = reader.csv(path)
    return table.select(*columns) if columns else table


def read_after_preamble(spark: SparkSession, path: str, schema: str, skip: int = 10) -> DataFrame:
    """Delimited text whose header follows ``skip`` lines of notes in every file.

    Files are split as any text is. A row knows where its block starts in its file; notes and header are dropped from the blocks
    that start a file, as the lines pass by, and nothing from the others. A file whose notes do not end in its first block
    makes the query fail. Lines in a file's notes may hold anything, an empty file gives nothing.
    """

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, partial = None, 0, False

        def ended() -> None:
            if at is not None and at[1] == 0 and partial and seen <= skip:
                raise ValueError(f"the {skip} lines of notes of a file do not end in its first block")

        for batch in batches:
            files, starts, cut = (batch.column(c).to_numpy() for c in ("file", "start", "cut"))
            edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(files)]):
                if first == last:
                    continue
                if at != (files[first], starts[first]):
                    ended()
                    at, seen, partial = (files[first], starts[first]), 0, bool(cut[first])
                begin = first if starts[first] else min(last, first + max(0, skip + 1 - seen))
                seen += last - first
                if begin < last:
                    yield pa.RecordBatch.from_arrays([batch.column("value").slice(begin, last - begin)], ["value"])
        ended()

    block = F.col("_metadata")
    lines = spark.read.text(path).select(
        "value", F.xxhash64(block["file_path"]).alias("file"), block["file_block_start"].alias("start"),
        (block["file_block_length"] < block["file_size"]).cast("int").alias("cut"),
    )
    body = lines.mapInArrow(drop, "value string").filter(F.length("value") > 0)
    parsed = F.from_csv("value", F.lit(schema), {"nullValue": MISSING})
    return body.select(parsed.alias("r")).select("r.*")


HEADERS_AT_ONCE = 64


def file_headers(spark: SparkSession, path: str, separator: str = ",") -> list[tuple[str, tuple[str, ...]]]:
    """Each file below ``path`` with the names in its first line, in the order of the files' paths.

    A scan stops after one line of each block, so files of any size cost little; what is gathered are names only. A byte-order
    mark and quotes around names are dropped, an empty file has no names.
    """
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    found: dict[str, tuple[str, ...]] = {}
    for start in range(0, len(files), HEADERS_AT_ONCE):
        some = [spark.read.text(f).limit(1).select(F.lit(f).alias("file"), "value") for f in files[start : start + HEADERS_AT_ONCE]]
        for r in reduce(DataFrame.union, some).collect():
            line = (r.value or "").lstrip("\ufeff").rstrip("\r")
            found[r.file] = next(csv.reader([line], delimiter=separator), ()) if line else ()
    return [(f, tuple(n.strip() for n in found.get(f, ()))) for f in files]


def merged_names(headers: Sequence[tuple[str, Sequence[str]]]) -> list[str]:
    """All names of the headers, each where it was first seen."""
    return list(dict.fromkeys(n for _, names in headers for n in names))


def read_by_headers(
    spark: SparkSession, path: str, types: Mapping[str, str], default: str = "string", separator: str = ","
) -> DataFrame:
    """One table of all files below ``path``, whose columns differ: columns go by name, those a file lacks are missing.

    ``types`` gives types by name, ``default`` those of all other columns. Files with the same header are one scan with a
    declared schema, so nothing is inferred from values and unused columns are not parsed.
    """
    headers = [(f, names) for f, names in file_headers(spark, path, separator) if names]
    alike: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers:
        if len(set(names)) < len(names):
            raise ValueError(f"a column comes twice in {file}")
        alike.setdefault(names, []).append(file)
    every = merged_names(headers)
    kind = {n: types.get(n, default) for n in every}
    if not every:
        raise ValueError("no file has a header")
    reader = spark.read.option("header", True).option("nullValue", MISSING).option("sep", separator).option("enforceSchema", False)
    scans = []
    for names, files in alike.items():
        table = reader.schema(", ".join(f"`{n}` {kind[n]}" for n in names)).csv(files)
        scans.append(table.select(*[F.col(f"`{n}`") if n in names else F.lit(None).cast(kind[n]).alias(n) for n in every]))
    return reduce(DataFrame.unionByName, scans)


def header_names(table: DataFrame, piece: str) -> list[str]:
    """Column names holding a piece of text, e.g. the scenarios of a salinity table."""
    return [c for c in table.columns if piece in c]


def surveys_of(table: DataFrame, dimension: DataFrame, key: str = "source") -> DataFrame:
    """Observations of the surveys that a filtered dimension table names.

    The dimension is small: a row for each survey. Stored by survey, the observations' folders are then pruned when the query
    runs, by the keys that the dimension's filter, a comparison, leaves.
    """
    return table.join(F.broadcast(dimension.select(key).distinct()), key, "left_semi")


def survey_observations(
    spark: SparkSession, path: str, sources: Sequence[str] | None = SURVEYS, end_year: int | None = None
) -> DataFrame:
    """Observations of the named surveys up to a year.

    Store the table partitioned by source: the survey filter then prunes folders and the
    year filter is pushed to the scan.
    """
    table = spark.read.parquet(path)
    if sources is not None:
        table = table.filter(F.col("source").isin(list(sources)))
    if end_year is not None:
        table = table.filter(F.col("year") <= end_year)
    return table


def plankton_samples(
    spark: SparkSession, path: str, sources: Sequence[str] | None = PLANKTON_SURVEYS, time_consistent: bool = False
) -> DataFrame:
    """Plankton counts of the named surveys.

    ``time_consistent`` keeps the taxa marked as counted alike through the years, in a
    boolean column ``time_consistent``.
    """
    table = survey_observations(spark, path, sources)
    return table.filter("time_consistent") if time_consistent else table
