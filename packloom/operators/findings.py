"""Analyzer findings: JSON envelopes to rows, filters, order, grouping."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import descriptor, path_order


def _text(v: Column, path: str) -> Column:
    """A string at a path of a variant, null for other types."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def walk_for_key(value, key: str):
    """Depth first: an object's own string under the key, then its children in
    order of their names; arrays in order. None if there is none."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get(key), str):
                return x[key]
            stack += [x[k] for k in sorted(x, reverse=True)]
        elif isinstance(x, list):
            stack += reversed(x)
    return None


def _walked(js: Column) -> Column:
    find = lambda t: None if t is None else walk_for_key(json.loads(t), "primary_path")
    return F.pandas_udf(lambda s: pd.Series([find(t) for t in s], dtype=object), "string")(js)


def parse_envelope(df: DataFrame, raw: str = "raw", keys: list[str] = ()) -> DataFrame:
    """(keys, raw JSON) -> one row per finding with a path; ``ord`` is its place
    in the envelope. No ``findings``: no rows; malformed JSON fails the query."""
    items = F.try_variant_get(F.parse_json(raw), "$.findings", "array<variant>")
    rows = df.select(*keys, F.posexplode(items).alias("ord", "f"))
    f = F.col("f")
    kind = F.try_variant_get(f, "$.kind", "variant")
    kind_type = F.schema_of_variant(kind)
    tag = F.when(kind_type == "STRING", kind.cast("string")).when(kind_type.startswith("OBJECT"), F.get(F.json_object_keys(F.to_json(kind)), F.lit(0)))
    near = F.coalesce(_text(f, "$.primary_path"), _text(f, "$.impact_surface.primary_path"))
    # Only findings without a path of their own, but with such a key, are walked.
    js = F.to_json(f)
    deep = _walked(F.when(near.isNull() & js.contains('"primary_path"'), js))
    path = F.coalesce(near, deep, _text(f, "$.path"))
    return rows.select(
        *keys,
        F.col("ord").cast("bigint").alias("ord"),
        _text(f, "$.id").alias("id"),
        path.alias("primary_path"),
        tag.alias("kind"),
        F.try_variant_get(f, "$.confidence", "double").alias("confidence"),
        *(_text(f, f"$.{k}").alias(k) for k in ("severity", "tier", "evidence", "suggested_action")),
    ).where("primary_path is not null")


def check_min_confidence(value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError(f"min confidence must be between 0 and 1, got {value}")
    return value


def filter_findings(findings: DataFrame, min_confidence: float | None = None, exclude_ids: list[str] = ()) -> DataFrame:
    """Unknown confidence and unknown ids survive."""
    if min_confidence is not None:
        findings = findings.where(F.col("confidence").isNull() | (F.col("confidence") >= check_min_confidence(min_confidence)))
    if exclude_ids:
        findings = findings.where(F.col("id").isNull() | ~F.col("id").isin(list(exclude_ids)))
    return findings


def exclude_ids(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """As above for a table of ids: an anti join, which null ids survive."""
    return findings.join(ids.select("id"), "id", "left_anti")


def rank_order() -> list[Column]:
    """Confidence descending, unknown last, then path by component, then place."""
    return [F.coalesce("confidence", F.lit(float("-inf"))).desc(), path_order(F.col("primary_path")), F.col("ord")]


def ranked(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank_order())).cast("bigint"))


def unique_paths(ranked_findings: DataFrame, keys: list[str]) -> DataFrame:
    """Each path once, at its first rank."""
    return ranked_findings.groupBy(*keys, "primary_path").agg(F.min("rank").alias("rank"))


def label(row_id: Column) -> Column:
    d = descriptor(F.col("kind"), F.col("severity"), F.col("tier"), F.col("confidence"))
    name = F.coalesce(row_id, F.lit("finding"))
    return F.when(d == "", name).otherwise(F.concat(name, F.lit(": "), d))


def co_findings(ranked_findings: DataFrame, keys: list[str]) -> DataFrame:
    """Per path: first rank and all its findings' labels in order of rank; a
    grouping, where the definition reads like a self-join."""
    rows = ranked_findings.select(*keys, "primary_path", F.struct("rank", label(F.col("id")).alias("label")).alias("x"))
    out = rows.groupBy(*keys, "primary_path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return out.select(*keys, "primary_path", F.col("xs")[0]["rank"].alias("rank"), F.array_join(F.transform("xs", lambda x: x["label"]), "; ").alias("labels"))
