"""Lists of files, their contents, walks with globs, entry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_regex, is_glob, matches_any
from ..operators.relations import first_seen


def files_list(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """Newline list -> (keys, ord, path): trimmed, without blanks and #-lines."""
    rows = df.select(*keys, F.posexplode(F.split(raw, "\n")).alias("ord", "path")).withColumn("path", F.trim(F.translate("path", "\r\t", "  ")))
    return rows.where((F.col("path") != "") & ~F.col("path").startswith("#")).withColumn("ord", F.col("ord").cast("bigint"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, content) of every file below root, one row each."""
    base = root.rstrip("/") + "/"
    df = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    path = F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    return df.select(F.substr(path, F.lit(len(base) + 1)).alias("path"), F.col("value").alias("content"))


def walk(paths: DataFrame, include: list[str], exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Paths that include patterns name, each owned by the first pattern that
    adds it, less excluded ones; and the patterns that own none. ``.git`` and
    ``target`` are never entered. Invalid include globs match nothing."""
    tree = paths.where(~F.exists(F.split("path", "/"), lambda p: p.isin(".git", "target")))
    found = None
    for k, pattern in enumerate(include):
        try:
            hit = tree.where(F.col("path").rlike(glob_regex(pattern))) if is_glob(pattern) else tree.where(F.col("path") == pattern)
        except ValueError:
            continue
        part = hit.select("path", F.lit(k).alias("pattern_ord"))
        found = part if found is None else found.unionByName(part)
    spark = paths.sparkSession
    names = spark.createDataFrame(list(enumerate(include)), "pattern_ord int, pattern string")
    if found is None:
        return spark.createDataFrame([], "path string, pattern_ord int"), names
    owned = first_seen(found.where(~matches_any(F.col("path"), list(exclude))))
    return owned, names.join(owned.select("pattern_ord").distinct(), "pattern_ord", "left_anti")


def entry_files(members: DataFrame, files: DataFrame) -> DataFrame:
    """Existing src/main.rs and src/lib.rs of each member (name, dir)."""
    kinds = F.explode(F.array(F.struct(F.lit("main").alias("kind"), F.lit("src/main.rs").alias("suffix")), F.struct(F.lit("lib").alias("kind"), F.lit("src/lib.rs").alias("suffix"))))
    wanted = members.select("name", "dir", kinds.alias("k")).select("name", F.col("k.kind").alias("kind"), F.when(F.col("dir") == "", F.col("k.suffix")).otherwise(F.concat_ws("/", "dir", "k.suffix")).alias("path"))
    return wanted.join(files, "path")


def scoped(listed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed files that exist, in order; and counts (included, skipped)."""
    rows = listed.join(files, "path", "left")
    return rows.where("content is not null"), rows.agg(F.count("content").alias("included"), F.count_if(F.col("content").isNull()).alias("skipped"))


def expansion_wanted(mode: str, diff: DataFrame) -> bool:
    """on, off, or auto: only if a Rust file changed."""
    if mode == "auto":
        return not diff.where(F.col("path").endswith(".rs")).isEmpty()
    return mode == "on"
