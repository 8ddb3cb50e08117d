"""Joins and aggregates over paths, stems, dependencies and provenance.

Theta joins of the definitions (whole-word containment, path prefixes) become
equi-joins: texts explode into their distinct words, paths into their
ancestors, and into suffixes of the lengths that the other side has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import free_name, path_order, stem


def stems(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.select(stem(F.col(path)).alias("stem")).where("stem is not null").distinct()


def matched_stems(tests: DataFrame, stem_rows: DataFrame, key: str = "path", source: str = "source") -> DataFrame:
    """Tests that mention stems as whole words: key, sorted matched_stems."""
    words = F.array_distinct(F.regexp_extract_all(F.col(source), F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    hits = tests.select(key, F.explode(words).alias("stem")).join(stem_rows, "stem")
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("stem")).alias("matched_stems"))


def member_files(paths: DataFrame, members: DataFrame, path: str = "path", directory: str = "dir") -> DataFrame:
    """Changed files under a member's directory (whole components)."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.select(path, F.explode(up).alias(directory)).join(members, directory)


def error_files(diff: DataFrame, errors: DataFrame, path: str = "path", file: str = "file") -> DataFrame:
    """Adds has_error: whether an erroneous file ends with the path or the
    path with it; the match may be cut inside a name. Null paths have none;
    null files match nothing; an empty one ends every path."""
    a = diff.select(F.col(path).alias("a")).where("a is not null").distinct()
    b = errors.select(F.col(file).alias("b")).where("b is not null").distinct()

    def ends(rows, c, other, d):
        """Pairs (c, d) where d, of ``other``, is a suffix of c."""
        lengths = sorted(r[0] for r in other.select(F.length(d)).distinct().collect())  # of paths: few
        cut = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(c)), lambda n: F.right(F.col(c), n))
        return rows.select(c, F.explode(cut).alias(d)).join(other, d)

    hit = ends(a, "a", b, "b").select("a").union(ends(b, "b", a, "a").select("a")).distinct()
    mark, key = free_name(diff, "hit"), free_name(diff, "a")
    hit = hit.select(F.col("a").alias(key), F.lit(True).alias(mark))
    return diff.join(hit, F.col(path) == F.col(key), "left").drop(key).withColumn("has_error", F.coalesce(mark, F.lit(False))).drop(mark)


def external_dependencies(dependencies: DataFrame, members: DataFrame) -> DataFrame:
    """Normal dependencies that are no workspace members, distinct."""
    return dependencies.where("kind = 'normal'").select("name").distinct().join(members.select("name"), "name", "left_anti")


def with_content(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed paths with their content; null where there is no such file."""
    return listed.join(files, "path", "left")


def with_hunks(files: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """Files of a diff with their hunks in order; none for binary files."""
    body = F.struct("hunk", "old_start", "old_lines", "new_start", "new_lines", "body")
    grouped = hunks.groupBy(*keys, "path").agg(F.array_sort(F.collect_list(body)).alias("hunks"))
    return files.join(grouped, [*keys, "path"], "left")


def provenance(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Events (seq, path, source, allowed, reason) per path: sorted distinct
    sources, the last status, and the reason, which sticks."""
    status = F.when(F.col("allowed"), F.lit("included")).otherwise(F.lit("suppressed"))
    return events.groupBy(*keys, "path").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max_by(status, "seq").alias("status"), F.max("reason").alias("reason"))


def provenance_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(F.col("status") == "included").alias("included"), F.count_if(F.col("status") == "suppressed").alias("suppressed"))


def first_seen(paths: DataFrame) -> DataFrame:
    """(pattern_ord, path) -> each path at the first pattern that adds it."""
    return paths.groupBy("path").agg(F.min("pattern_ord").alias("pattern_ord"))


def sorted_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.select(path).distinct().orderBy(path_order(F.col(path)))
