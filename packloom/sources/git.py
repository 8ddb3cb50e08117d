"""Diffs: capture by git on the driver, parsing in Spark."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import status_of
from ..operators.relations import with_hunks

_RECORD = r"\G(?:[RC][^\x00]*\x00[^\x00]+\x00[^\x00]+|[^RC\x00][^\x00]*\x00[^\x00]+)(?:\x00|$)"


def name_status(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """NUL-separated name-status text -> (keys, ord, path, old_path, status)."""
    rows = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(raw), F.lit(_RECORD), F.lit(0))).alias("ord", "rec"))
    part = F.split("rec", "\\x00")
    moved = F.col("rec").rlike("^[RC]")
    return rows.select(
        *keys, F.col("ord").cast("bigint").alias("ord"), F.when(moved, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1))).alias("path"), F.when(moved, F.get(part, F.lit(1))).alias("old_path"), status_of(F.get(part, F.lit(0))).alias("status"), F.lit(False).alias("binary")
    )


def b_path(header):
    """New path of a ``diff --git`` line: after the last `` b/``."""
    return F.nullif(F.regexp_extract(header, "^.* b/(.*)$", 1), F.lit(""))


def hunk_ranges(line) -> dict:
    """Columns of ``@@ -a,b +c,d @@``: a missing or bad count is 1, a bad start 0."""
    out = {}
    for sign, name in (("-", "old"), ("+", "new")):
        at = rf"^@@ -[^ ]* \+([^ ,]*),?([^ ]*)" if sign == "+" else r"^@@ -([^ ,]*),?([^ ]*)"
        number = lambda k, default, at=at: F.coalesce(F.regexp_extract(line, at, k).try_cast("int"), F.lit(default))
        out |= {f"{name}_start": number(1, 0), f"{name}_lines": number(2, 1)}
    return out


def patch_hunks(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """Unified patch -> (keys, path, hunk, ranges, body), hunks numbered from 1
    over the patch. Windows carry the current file and hunk forward."""
    lines = df.select(*keys, F.posexplode(F.split(raw, "\n", -1)).alias("pos", "line"))
    here = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_file, is_hunk = F.col("line").startswith("diff --git "), F.col("line").startswith("@@ ")
    state = lines.withColumns(
        {
            "file": F.last(F.when(is_file, F.struct(b_path("line").alias("path"), F.col("pos").alias("at"))), ignorenulls=True).over(here),
            "head": F.last(F.when(is_hunk, F.struct(F.col("line").alias("text"), F.col("pos").alias("at"))), ignorenulls=True).over(here),
            "hunk": F.sum(is_hunk.cast("bigint")).over(here),
        }
    )
    body = state.where("head.at > file.at and file.path is not null and not (line like 'diff --git %')")
    marks = F.col("line").startswith("--- ") | F.col("line").startswith("+++ ") | F.col("line").startswith("Binary files ")
    last = Window.partitionBy(*keys)
    body = body.withColumn("text", F.when(~F.col("line").startswith("@@ ") & ~marks & ~((F.col("line") == "") & (F.col("pos") == F.max("pos").over(last))), F.concat("line", F.lit("\n"))).otherwise(""))
    grouped = body.groupBy(*keys, F.col("file.path").alias("path"), "hunk", F.col("head.text").alias("head")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("body"))
    return grouped.select(*keys, "path", "hunk", *(c.alias(n) for n, c in hunk_ranges(F.col("head")).items()), "body")


def git_diff(spark: SparkSession, root: str, rev_range: str | None = None) -> DataFrame:
    """Files and hunks of a work tree's diff; no repository or an unknown
    revision gives no rows."""

    def out(*args: str) -> str:
        got = subprocess.run(["git", "-C", root, "diff", *args, *([rev_range] if rev_range else ["HEAD"])], capture_output=True, text=True, check=False)
        return got.stdout if got.returncode == 0 else ""

    raw = spark.createDataFrame([(0, out("--name-status", "-z"), out("--no-color"))], "id int, names string, patch string")
    return with_hunks(name_status(raw, "names", ["id"]), patch_hunks(raw, "patch", ["id"]), ["id"]).drop("id")
