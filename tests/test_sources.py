from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brackish import session
from brackish.sources import readers, schemas, writers


def test_read_table_with_mark_and_missing_values(spark, rows, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿lifestage,taxname,ibmr,taxlifestage\nAdult,A,NA,A Adult\nAdult,A,NA,A Adult\n".encode())
    table = readers.read_table(spark, str(tmp_path / "t.csv"), schemas.TAXON_GROUPS, ["taxlifestage", "ibmr"])
    assert rows(table) == [("A Adult", None), ("A Adult", None)]
    assert table.distinct().count() == 1
    inferred = readers.read_table(spark, str(tmp_path / "t.csv"))
    assert inferred.columns == ["lifestage", "taxname", "ibmr", "taxlifestage"]


def test_preamble_is_skipped_in_every_file(spark, rows, tmp_path):
    for i in range(2):
        notes = "".join(f"note {k}, 2001-01-01\n" for k in range(10))
        (tmp_path / f"run{i}.csv").write_text(notes + f"datetime,a_bn_x,sal_y\n2022-06-0{i + 1} 00:00:00,1.{i},NA\n")
    table = readers.read_after_preamble(spark, str(tmp_path), "datetime timestamp_ntz, a_bn_x double, sal_y double")
    assert rows(table) == [(dt.datetime(2022, 6, 1), 1.0, None), (dt.datetime(2022, 6, 2), 1.1, None)]
    assert readers.header_names(table, "sal_") == ["sal_y"]


def test_preamble_of_a_large_file_is_read_in_several_tasks(spark, tmp_path):
    """Blocks that do not start the file keep all their lines, whatever they look like."""
    lines = [f"{i},{'x' * (i % 60)},note {i}" for i in range(60_000)]
    notes = [f"note {k}" for k in range(10)]
    for name, body in (("a.csv", lines), ("b.csv", lines[:3]), ("c.csv", [])):
        (tmp_path / name).write_text("\n".join([*notes, "k,text,mark", *body]) + "\n")
    (tmp_path / "short.csv").write_text("note 1\nnote 2\n")
    (tmp_path / "empty.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        table = readers.read_after_preamble(spark, str(tmp_path), "k int, text string, mark string")
        assert table.rdd.getNumPartitions() > 4
        got = sorted((r.k, r.text or "", r.mark) for r in table.collect())
        assert got == sorted((i, "x" * (i % 60), f"note {i}") for i in [*range(60_000), 0, 1, 2])
        with pytest.raises(Exception, match="first block"):
            readers.read_after_preamble(spark, str(tmp_path / "a.csv"), "k int, text string, mark string", skip=50_000).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_with_other_columns_are_one_table(spark, rows, tmp_path):
    (tmp_path / "1.csv").write_text("region,sal_base,sal_a\n1,0.5,NA\n")
    (tmp_path / "2.csv").write_bytes('﻿"sal_b",region\r\n2.5,2\r\n'.encode())
    (tmp_path / "3.csv").write_text("region,sal_base,sal_a\n3,1.5,2\n")
    (tmp_path / "4.csv").write_text("")
    headers = readers.file_headers(spark, str(tmp_path))
    assert [n for _, n in headers] == [("region", "sal_base", "sal_a"), ("sal_b", "region"), ("region", "sal_base", "sal_a")]  # Spark lists no empty file
    table = readers.read_by_headers(spark, str(tmp_path), {"region": "int"}, "double")
    assert table.dtypes == [("region", "int"), ("sal_base", "double"), ("sal_a", "double"), ("sal_b", "double")]
    assert rows(table) == [(1, 0.5, None, None), (2, None, None, 2.5), (3, 1.5, 2.0, None)]
    (tmp_path / "5.csv").write_text("region,region\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        readers.read_by_headers(spark, str(tmp_path), {})


def test_folders_are_pruned_by_a_dimension(spark, rows, tmp_path):
    df = spark.createDataFrame([(s, 2000 + i, float(i)) for s in ("EMP", "STN", "SKT") for i in range(50)], "source string, year int, v double")
    path, names = str(tmp_path / "obs"), str(tmp_path / "names")
    writers.write_observations(df, path)
    spark.createDataFrame([("EMP", 1975), ("STN", 2002), ("SKT", 2002)], "source string, since int").write.parquet(names)
    picked = readers.surveys_of(spark.read.parquet(path), spark.read.parquet(names).filter("since < 1980"))
    assert rows(picked.groupBy("source").count()) == [("EMP", 50)]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0], plan[:3000]


def test_survey_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("EMP", 2000, 1.0), ("STN", 2022, 2.0), ("Other", 2000, 3.0)], "source string, year int, v double")
    path = str(tmp_path / "obs")
    writers.write_observations(df, path)
    table = readers.survey_observations(spark, path, ["EMP", "STN"], 2021)
    assert table.count() == 1
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan or "PartitionFilters: [source" in plan
    assert "LessThanOrEqual(year,2021)" in plan
    flagged = df.withColumn("time_consistent", F.col("year") < 2010)
    writers.write_observations(flagged, str(tmp_path / "zoop"))
    assert readers.plankton_samples(spark, str(tmp_path / "zoop"), time_consistent=True).count() == 1


def test_write_and_continue(spark, rows, tmp_path):
    df = spark.createDataFrame([("b", None, True), ("a", 1.5, None)], "k string, v double, f boolean")
    back = writers.write_and_continue(df, str(tmp_path / "out"), ["k"])
    assert rows(back) == [("a", 1.5, None), ("b", None, True)]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert "b,NA,true" in text


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
