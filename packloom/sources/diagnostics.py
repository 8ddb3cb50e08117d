"""Compiler message streams: JSON lines to diagnostics."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import level_of

_SPAN = "struct<file_name: string, line_start: int, line_end: int, column_start: int, column_end: int, is_primary: boolean>"
SCHEMA = f"reason string, success boolean, message struct<message: string, level: string, code: struct<code: string>, spans: array<{_SPAN}>, rendered: string>"


def message_stream(df: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """JSON lines -> diagnostics. Blank lines, lines that are no object,
    malformed JSON and other reasons are passed over."""
    rows = df.where(F.trim(line).startswith("{")).select(*keys, F.from_json(F.col(line), SCHEMA, {"mode": "PERMISSIVE"}).alias("m"))
    rows = rows.where("m.reason = 'compiler-message' and m.message is not null")
    spans = F.transform(
        "m.message.spans",
        lambda s: F.struct(s["file_name"].alias("file"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), s["column_start"].alias("col_start"), s["column_end"].alias("col_end"), s["is_primary"].alias("is_primary")),
    )
    return rows.select(*keys, level_of(F.col("m.message.level")).alias("level"), F.col("m.message.message").alias("message"), F.col("m.message.code.code").alias("code"), spans.alias("spans"), F.col("m.message.rendered").alias("rendered"))


def primary_span(spans):
    return F.get(F.filter(spans, lambda s: s["is_primary"]), F.lit(0))


def is_error(level):
    return level.isin("error", "ice")


def referenced_files(diagnostics: DataFrame, keys: list[str] = ()) -> DataFrame:
    return diagnostics.select(*keys, F.explode("spans").alias("s")).select(*keys, F.col("s.file").alias("path")).distinct()


def last_error(spark: SparkSession, root: str, command: tuple[str, ...] = ("cargo", "check", "--message-format=json")) -> tuple[bool, DataFrame]:
    """Run a build on the driver; (whether it succeeded, diagnostics). Without
    the command there are none."""
    try:
        got = subprocess.run(command, cwd=root, capture_output=True, text=True, check=False)
        ok, lines = got.returncode == 0, got.stdout.splitlines()
    except FileNotFoundError:
        ok, lines = False, []
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "pos long, line string")
    return ok, message_stream(df, "line", ["pos"])


def metadata(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """Workspace metadata JSON -> members with their dependencies."""
    dep = "struct<name: string, req: string, kind: string, optional: boolean>"
    schema = f"packages array<struct<id: string, name: string, version: string, manifest_path: string, dependencies: array<{dep}>>>, workspace_members array<string>"
    rows = df.select(*keys, F.from_json(raw, schema).alias("m")).select(*keys, "m.workspace_members", F.explode("m.packages").alias("p"))
    return rows.where(F.array_contains("workspace_members", F.col("p.id"))).select(*keys, "p.name", "p.version", "p.manifest_path", "p.dependencies")


def cargo_metadata(spark: SparkSession, root: str) -> DataFrame:
    try:
        got = subprocess.run(["cargo", "metadata", "--no-deps", "--format-version=1"], cwd=root, capture_output=True, text=True, check=False)
        raw = got.stdout if got.returncode == 0 else json.dumps({"packages": [], "workspace_members": []})
    except FileNotFoundError:
        raw = json.dumps({"packages": [], "workspace_members": []})
    return metadata(spark.createDataFrame([(0, raw)], "id int, raw string"), "raw", ["id"]).drop("id")
