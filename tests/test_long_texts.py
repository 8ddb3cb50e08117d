import os
import random
import subprocess
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from packloom.plans import long_texts

ROOT = Path(__file__).resolve().parents[1]
FIT = """
from pyspark.sql import SparkSession, functions as F
from packloom.plans import render
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
i = F.col("id").cast("string")
rows = spark.range(2000).select(F.lit("en").alias("lang"), F.concat(F.lit("e"), i).alias("path"), i.alias("crate"), F.lit("lib").alias("kind"), F.repeat(F.concat(F.lit("abcdefgh "), i % 7), 12000).alias("rendered"), F.lit(1).alias("lines"))
render.entries(rows, ["lang"]).write.format("noop").mode("overwrite").save()
"""
WRITTEN = """
import sys
from pyspark.sql import SparkSession, functions as F
from packloom.queries import QUERIES
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.parquet.columnarReaderBatchSize", "50").getOrCreate()
spark.range(0, 1500, 1, 8).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.repeat(F.concat(F.lit("abcdefgh "), F.col("id") % 7), 10000).alias("text")).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(sys.argv[1] + "/documents.parquet")
QUERIES["sink_entry_md"](spark, sys.argv[1]).write.parquet(sys.argv[1] + "/out")
"""


@pytest.mark.parametrize("long", [1, long_texts.LONG])
def test_joined_in_order(spark, long):
    """Nulls, ties, empty and repeated texts, null keys; long=1: as very long ones."""
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(4), r.choice([None, "e1", "e10", "e2", "é", "é"]), r.choice([None, "", "x\n", "ü☃", "y" * r.randrange(300), "\0z"])) for _ in range(500)]
    found = long_texts.joined(spark.createDataFrame(rows, "k string, j int, o string, t string").repartition(7), ["k", "j"], F.col("o"), F.col("t"), lambda n: f"{n}:", long)
    want: dict = {}
    for k, j, o, t in rows:
        want.setdefault((k, j), []).append((o is not None, (o or "").encode(), t))
    text = lambda g: f"{len(g)}:" + "".join(t.decode() for *_, t in sorted((a, o, t.encode()) for a, o, t in g if t is not None))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((*k, text(g)) for k, g in want.items()), key=str)
    assert found.schema.simpleString() == "struct<k:string,j:int,text:string>"


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, o string, t string")
    assert long_texts.joined(none, ["k"], F.col("o"), F.col("t"), str).collect() == []


def test_long_text_fits():
    """One text of 240 MB in a heap of 512 MB: neither several copies of it nor a row buffer of twice its length fit."""
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", FIT], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]


def test_long_text_is_written(tmp_path):
    """One text of 150 MB as Parquet from a heap of 800 MB: the copies of Spark's writer for statistics and dictionary do not fit."""
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 800m pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", WRITTEN, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    docs = sorted((f"e{i}", f"### `e{i}` — s / lib (1 lines)\n```rust\n" + f"abcdefgh {i % 7}" * 10000 + "\n```\n\n") for i in range(1500))
    text = pq.read_table(tmp_path / "out")["text"][0].as_py()
    assert len(text) > 150_000_000 and text == "1500 entry file(s).\n\n" + "".join(t for _, t in docs)


def test_session_of_a_large_table(spark, tmp_path):
    """A large table's session has other defaults for Parquet files; what the caller set holds, and the caller's session stays as it is."""
    spark.range(10).write.parquet(str(tmp_path / "t"))
    key, before = "spark.sql.parquet.compression.codec", spark.conf.getAll
    found = long_texts.table(spark, str(tmp_path / "t"), 1)
    assert found.sparkSession.conf.get(key) == "uncompressed" and found.count() == 10
    assert spark.conf.getAll == before and long_texts.table(spark, str(tmp_path / "t")).sparkSession is spark
    spark.conf.set(key, "gzip")
    try:
        assert long_texts.table(spark, str(tmp_path / "t"), 1).sparkSession.conf.get(key) == "gzip"
    finally:
        spark.conf.unset(key)
