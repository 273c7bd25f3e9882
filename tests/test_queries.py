"""Every registered query against its SQL, run by DuckDB on the same tables."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tenderwatch.plans import catalog, check_sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = catalog.queries(), check_sql.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=lambda r: [(v is not None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


def test_entry_works_without_the_optional_parts(tmp_path):
    """A copy without the training-data operators and their pipeline still registers all others."""
    root = Path(entry_module.__file__).parent
    shutil.copytree(root / "tenderwatch", tmp_path / "tenderwatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL))]


def test_entry(spark):
    assert entry_module.entry(spark).count() == 3911


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_notices_land_in_many_files_with_a_key_in_one(spark, tmp_path):
    """Keys and rows without one spread; copies of a key stay together and in order."""
    text = F.col("id").cast("string")
    key = F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    rows = spark.range(400).select(key.alias("id_del_proceso"), *[text.alias(c) for c in catalog._LANDED[1:]])
    catalog._land(rows, str(tmp_path / "landing"))
    landed = spark.read.json(str(tmp_path / "landing")).withColumn("file", F.input_file_name())
    assert landed.count() == 400
    assert landed.where("id_del_proceso IS NULL").select("file").distinct().count() > 1
    files = landed.where("id_del_proceso IS NOT NULL").groupBy("id_del_proceso").agg(F.count_distinct("file").alias("n"), F.first("file").alias("file"))
    assert files.agg(F.max("n")).first()[0] == 1 and files.select("file").distinct().count() > 1
    for file in (tmp_path / "landing").glob("part-*"):
        found = [json.loads(line) for line in file.read_text().splitlines()]
        found = [(r["id_del_proceso"], r["entidad"]) for r in found if "id_del_proceso" in r]
        assert found == sorted(found)
