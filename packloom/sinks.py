"""The audit log of redactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_entries(redactions: DataFrame, ts) -> DataFrame:
    return redactions.select(ts.cast("bigint").alias("ts"), "rule_id", "category", "severity", "hash4")


def append_log(redactions: DataFrame, path: str, ts) -> None:
    """Append JSON lines."""
    log_entries(redactions, ts).write.mode("append").json(path)


def newest(log: DataFrame, order: list, n: int) -> DataFrame:
    """The newest n entries: a distributed top-k."""
    return log.orderBy(*order).limit(n)


def newest_per(log: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
