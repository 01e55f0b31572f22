import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

from photolake.operators.graph import components
from photolake.storage import Table

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def rows(df):
    return sorted((r["id"], r["name"]) for r in df.collect())


def test_a_failed_write_changes_nothing(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", SCHEMA)
    assert table.read().count() == 0
    table.write(spark.createDataFrame([(1, "a")], SCHEMA))
    fails = spark.range(2).selectExpr("id", "IF(id = 1, raise_error('lost'), 'b') AS name")
    with pytest.raises(Exception, match="lost"):
        table.write(fails)
    assert rows(table.read()) == [(1, "a")]
    (tmp_path / "t" / "v2").mkdir(exist_ok=True)  # files without the mark of success
    assert rows(table.read()) == [(1, "a")]
    for k in range(3):
        table.write(spark.createDataFrame([(k, "c")], SCHEMA))
    assert rows(table.read()) == [(2, "c")] and len(list((tmp_path / "t").glob("v*"))) == 2


def test_appending(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/log", SCHEMA, {"name": "none"})
    for k in range(3):
        table.append(spark.createDataFrame([(k, "x")], SCHEMA))
    (tmp_path / "log" / "added-v1" / "broken").mkdir()
    assert rows(table.read()) == [(0, "x"), (1, "x"), (2, "x")]
    assert len(list((tmp_path / "log" / "added-v1").iterdir())) == 3
    table.write(table.read().where("id > 0"))
    assert rows(table.read()) == [(1, "x"), (2, "x")]


def test_without_a_shared_folder_setting():
    code = "from pyspark.sql import SparkSession as S\ns = S.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nfrom photolake.storage import shared_dir, stored\nassert shared_dir(s) == shared_dir(s)\nassert stored(s.range(3), 'x').count() == 3"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr[-2000:]


def test_components_of_a_hub_and_chains(spark):
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(1000, 1051), 1000)}
