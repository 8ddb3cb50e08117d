"""Texts of a key joined in order by way of the disk, for results of hundreds
of MB: an aggregate holds each of them several times on the heap."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import cache, cmp_to_key, partial
from itertools import groupby
from mmap import ACCESS_READ, mmap
from operator import itemgetter

from pyspark import SparkContext
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes from which a text is long, and that a value of Spark can have.
LONG, MOST = 64 << 20, (1 << 31) - (1 << 16)
#: What a row begins with at which the heap grows, and bytes of the heap for anything else.
GROW, SPARE = "\0grow", 60 << 20
#: Of Parquet files with long values in a column text: its statistics are two more copies of a value on the heap, its
#: dictionary is one, and compressing needs room for its result.
SINK = {"parquet.column.statistics.enabled#text": "false", "parquet.enable.dictionary#text": "false", "spark.sql.parquet.compression.codec": "uncompressed"}


def table(spark: SparkSession, path: str, large: int = LONG // 8) -> DataFrame:
    """The Parquet table at a path. One of ``large`` bytes belongs to a copy of
    the session, where ``SINK`` are defaults for what is written of it: what is
    set in ``spark``, or given to the writer as an option, holds, and nothing
    changes in ``spark``. Temporary views of such a table are the copy's.
    """
    found = spark.read.parquet(path)
    if _bytes(found) < large:
        return found
    own, given = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession()), spark.conf.getAll
    for k, v in SINK.items():
        if not {k, k.partition("#")[0]} & {*given}:
            own.conf.set(k, v)
    return own.read.parquet(path)


def joined(rows: DataFrame, keys: list[str], order: Column, text: Column, head: Callable[[int], str], long: int = LONG) -> DataFrame:
    """One row for each key: ``head(number of rows)``, which must not start
    with NUL, then all texts by ``order`` (a string; nulls first), equal ones
    by text; null texts count and add nothing. Keys are of types that Python
    hashes.

    Pieces of a task go to its temporary folder as they come, sorted is only
    their index, and the joined text reaches Spark out of a mapped file: once
    off the heap and once as a row on it. Two rows go ahead of the longest text
    of a task, and the filter takes them out again: at the first the executor
    collects its garbage, which shrinks its heap; the second is half as long as
    the text, for Spark's row buffer becomes twice as long as the row that it
    grows for. Of large inputs, each task has an executor for itself, as far as
    the cluster lets tasks ask for that; then, if a writer's two further copies
    of the text fit, a row after the first makes the heap grow for all three at
    once, else small objects at its former end lie in the way of the last one.
    """
    schema = T.StructType([*rows.select(*keys).schema, T.StructField("text", T.StringType())])
    dealt = rows.select(*keys, order.alias("__order"), text.alias("__text")).repartition(*keys)
    alone = _alone(rows.sparkSession) if _bytes(rows) >= LONG // 8 else None
    heap = (rows.sparkSession.sparkContext._jsc.sc().executorMemory() << 20) if alone else 0
    found = dealt.mapInArrow(partial(_joined, head=head, long=long, heap=heap), schema, profile=alone)
    # The call of a method also keeps the filter out of generated code, which would write each row anew.
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    grown = F.octet_length(F.repeat(F.lit(" "), F.substring("text", len(GROW) + 1, 10).cast("int")))
    return found.where(F.when(F.col("text") == "\0", collected == "").when(F.col("text").startswith(GROW), grown < 0).otherwise(~F.col("text").startswith("\0")))


def _bytes(rows: DataFrame) -> int:
    """As planned; of a table, of its files."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _alone(spark: SparkSession) -> ResourceProfile | None:
    """What asks for all cores of an executor for each task. With dynamic
    allocation that would ask for more executors; local mode can't do it."""
    context = spark.sparkContext
    if re.match(r"local(\[|$)", context.master) or context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    found = context._jsc.sc().statusStore().executorList(True)
    cores = [x.totalCores() for x in map(found.apply, range(found.size())) if x.id() != "driver" and x.totalCores()]
    return _cpus(context, min(cores)) if cores else None


@cache
def _cpus(context: SparkContext, n: int) -> ResourceProfile:
    """One for all frames: a stage with two is refused."""
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(n)).build


def _joined(batches: Iterator, head: Callable[[int], str], long: int, heap: int = 0) -> Iterator:
    with tempfile.TemporaryDirectory() as folder:
        groups = _gathered(batches, f"{folder}/pieces")
        with open(f"{folder}/pieces", "rb") as file:
            pieces = mmap(file.fileno(), 0, access=ACCESS_READ) if os.path.getsize(file.name) else b""
            for k, g in enumerate(sorted(groups.values(), key=lambda g: -sum(size for _, _, size in g["rows"]))):
                with open(f"{folder}/text", "wb") as out:
                    out.write(head(g["n"]).encode())
                    out.writelines(memoryview(pieces)[at : at + size] for _, at, size in _in_order(g["rows"], pieces))
                    size = out.tell()
                if size > MOST:
                    raise ValueError(f"a text of {size} bytes is more than a value of Spark can hold")
                if k == 0 and size >= long:  # the others find the buffer long enough
                    with open(f"{folder}/half", "wb") as half:
                        half.truncate(size // 2 + 64)
                    yield _row(g["key"], b"\0")
                    if (grow := 3 * size + SPARE) <= heap - 4 * SPARE:
                        yield _row(g["key"], f"{GROW}{grow}".encode())
                    yield from _released(_row(g["key"], half.name))
                yield from _released(_row(g["key"], out.name))


def _gathered(batches: Iterator, path: str) -> dict:
    """By key: its columns, the number of rows, and (order, place, size) of
    the texts, which go to the file."""
    import numpy as np
    import pyarrow as pa

    groups: dict = {}
    with open(path, "wb") as out:
        for b in batches:
            *keys, order, text = b.columns
            text = text.cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1] or bytes(8), "<i8")[text.offset :][: len(text) + 1]
            places = (ends[:-1] - ends[0] + out.tell()).tolist()
            if ends[-1] > ends[0]:
                out.write(memoryview(text.buffers()[2])[ends[0] : ends[-1]])
            values = zip(*(k.to_pylist() for k in keys), strict=True)
            rows = zip(order.cast(pa.large_binary()).to_pylist(), places, np.diff(ends).tolist(), strict=True)
            for i, (key, row, there) in enumerate(zip(values, rows, text.is_valid().to_pylist(), strict=True)):
                if key not in groups:
                    groups[key] = {"key": b.select(list(range(len(keys)))).take(pa.array([i])), "n": 0, "rows": []}
                groups[key]["n"] += 1
                if there:
                    groups[key]["rows"].append(row)
    return groups


def _in_order(rows: list, pieces) -> Iterator:
    def compared(a: tuple, b: tuple) -> int:
        x, y = (pieces[at : at + size] for _, at, size in (a, b))
        return (x > y) - (x < y)

    rows.sort(key=lambda r: (r[0] is not None, r[0] or b""))
    for _, same in groupby(rows, itemgetter(0)):
        same = list(same)
        yield from sorted(same, key=cmp_to_key(compared)) if len(same) > 1 else same


def _row(key, text: str | bytes):
    """A batch of one row; of a file's name, the text is the mapped file, which has no name any more."""
    import numpy as np
    import pyarrow as pa

    data = pa.memory_map(text).read_buffer() if isinstance(text, str) else pa.py_buffer(text)
    if isinstance(text, str):
        os.unlink(text)
    text = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, data.size], "<i4")), data])
    return pa.RecordBatch.from_arrays([*key.columns, text], names=[*key.schema.names, "text"])


def _released(batch) -> Iterator:
    """The batch, then an empty one: Spark frees a batch as it has read the next."""
    yield batch
    yield batch.slice(0, 0)
