"""Shared plumbing of the training-data operators.

Two things live here: where intermediate tables go (always a folder every
executor can see) and vectorised hashing of words straight from Arrow string
buffers, so that a text never becomes a list of Python strings.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder of this machine; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = os.path.join(tempfile.gettempdir(), "checkpoints", "packloom")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packloom-{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def drop_table(table: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    spark = table.sparkSession
    _delete(spark, table._staged)
    _written.remove((spark, table._staged))


def staged_tables() -> int:
    """How many tables are staged; ``drop_staged`` takes it for a mark."""
    return len(_written)


def drop_staged(since: int, keep: DataFrame) -> None:
    """Delete the tables staged after a mark, save ``keep``."""
    for spark, path in _written[since:]:
        if path != keep._staged:
            _delete(spark, path)
            _written.remove((spark, path))
    free_shuffles(keep.sparkSession)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """Queries run in here drop their shuffle files as they end, not when the
    driver next collects garbage."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced;
    it does so when the driver's collector finds them, which takes two rounds:
    what the first one frees held the others."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended already; the folder is the cluster's to clear
            continue


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: str, modulus: int):
    """crc32 of the column's text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# --- words and hashes --------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation, for words without the marks around them.
MARKS = _SPACE.copy()
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_R, _R_INV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words_of(data: np.ndarray, starts: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of texts that lie side by side in ``data``.

    ``starts``: len(texts) + 1 byte offsets, from 0. Words are runs of bytes
    other than ``gaps`` (0x20 and 0x09-0x0D); none spans two texts. Returns each word's
    64-bit hash and text number, and the byte at which it starts.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_LOWER[data] * up[:n], out=total[1:])
    h = mix((total[z] - total[a]) * down[a])
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(a, starts)))
    return h, doc, a


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of ``h``, one for each start."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, int(n) * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
    for k in range(n):
        out = mix(out * U64(0x2545F4914F6CDD1D) + h[k : k + m])
    return out


def text_chunks(column: pa.Array, most: int = 1 << 20):
    """Cut an Arrow string column into runs of rows of about ``most`` bytes
    (one text at least): yields (first row, row after the last, bytes,
    offsets). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def binary(arrays) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())
