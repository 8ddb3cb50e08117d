"""Document fingerprints by Order MinHash.

A sketch of k-mers that also keeps their order. Every k-mer of a text counts
with the number of its occurrence, so repeats are distinct. Each of ``m``
hash functions of a sketch selects the ``l`` k-mers with the smallest hashes;
they are put back in the order in which they stand in the text and hashed as
a tuple. The share of equal tuples estimates a similarity that falls with edit
distance, moved blocks included.

The m functions are the cells of one hash (a cell's k-mers are a uniform
sample, so its smallest are those of an independent function); a cell with
fewer than l k-mers takes the smallest ones of the cells after it. So functions
of a short text lean on the same k-mers: estimates stay unbiased within a few
hundredths (tested against 64 hash functions), but vary more than those of
independent functions would. Work is one sort per text, whatever m.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix

_K = 5
_CELLS = 64
_PICK = 2


def sketch(text: str, k: int = _K, cells: int = _CELLS, pick: int = _PICK) -> np.ndarray:
    """``cells`` 32-bit tuple hashes; all zero for the empty text. A text
    shorter than k is one k-mer of its own length."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.zeros(cells, np.uint32)
    k = min(k, len(c))
    n = len(c) - k + 1
    h = np.full(n, k * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for j in range(k):
        h = h * U64(0xD6E8FEB86659FD93) + c[j : j + n]
    h = mix(h)
    # Sort by k-mer, then place.
    o = np.argsort(h)
    new = np.concatenate(([True], h[o][1:] != h[o][:-1]))
    packed = np.sort((np.cumsum(new).astype(np.uint64) << U64(32)) | o.astype(np.uint64))
    at = (packed & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(new)
    times = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    own = h[at]
    v = mix(own + U64(0xA0761D6478BD642F) * (times.astype(np.uint64) + U64(1)))
    # Cell in the top bits: one sort puts cells side by side, smallest first.
    bits = cells.bit_length() - 1
    o = np.argsort(v)
    v, at, own = v[o], at[o], own[o]
    cut = np.searchsorted(v >> U64(64 - bits), np.arange(cells, dtype=np.uint64))
    # A short cell goes on into the next ones, from the last to the first.
    take = (cut[:, None] + np.arange(pick)[None, :]) % n if n >= pick else np.tile(np.arange(n), (cells, 1))
    places = at[take]
    order = np.argsort(places, axis=1, kind="stable")
    kmers = np.take_along_axis(own[take], order, 1)
    out = np.arange(cells, dtype=np.uint64)
    for j in range(kmers.shape[1]):
        out = mix(out * U64(0x2545F4914F6CDD1D) + kmers[:, j])
    return (out >> U64(32)).astype(np.uint32) | U64(1).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _follow(n_cells: int):
    """Sorted rows (part, place, id, text, tail) -> results. The row after a
    row of the same part is its next document; rows with ``tail`` set only
    serve as that."""

    def results(rows):
        held = None
        for part, id_, text, tail in rows:
            fp = sketch(text, cells=n_cells)
            if held is not None and held[0] == part and not held[4]:
                yield finish(held, text, fp)
            held = (part, id_, text, fp, tail)

    def finish(held, following, fp):
        _, id_, text, own, _ = held
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other = own if edited == text else sketch(edited, cells=n_cells)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (id_, len(text), digest, own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(own, other), likeness(own, fp))

    def run(frames):
        def rows():
            for f in frames:
                ids = [None if pd.isna(i) else int(i) for i in f["id"]]
                yield from zip(f["part"], ids, f["text"], f["tail"], strict=True)

        out = []
        for r in results(rows()):
            out.append(r)
            if len(out) == 2000:
                yield pd.DataFrame(out, columns=_NAMES).astype({"id": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=_NAMES).astype({"id": "Int64"})

    return run


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def order_minhash(docs: DataFrame, cells: int = _CELLS, part_chars: int = 8_000_000, most_parts: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text: the last floor(n/2) code
    points replaced by the first as many (or all) of the next document's.

    Returns per row: id_col, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (hex), near_edited and near_next (0 to 1). The next
    document is the next in ascending id; rows with equal ids follow each other
    in order of their texts' hashes, null ids come after all others, and after the last row
    comes the first. Null texts are empty; two empty texts are alike (1), an
    empty and another are not. Other columns are ignored. One row: its next is
    itself. Empty input: no rows.

    Rows are dealt by range of id - rows of one id, and those without, by their
    texts' hashes - to parts of about ``part_chars``, or larger ones if that
    makes more than ``most_parts``, and sorted there; the first row of the next
    part is sent along, so no task sees more than its part.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select("id", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"), "text")
    chars = F.length("text").cast("long")
    size = source.agg(F.sum(chars).alias("chars"), F.count("*").alias("n"), F.sum(F.when(F.col("id").isNull(), chars)).alias("nameless")).first()
    names = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not size.n:
        return spark.createDataFrame([], names).withColumnRenamed("id", id_col)
    each = max(part_chars, math.ceil(size.chars / most_parts))
    parts = max(1, math.ceil((size.chars - (size.nameless or 0)) / each))
    cuts = source.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = np.array(sorted(int(c) for c in cuts), np.int64)
    nameless = max(1, math.ceil((size.nameless or 0) / each))

    # Parts in order of (id, hash); an id that several cuts share has as many parts.
    def part_of(ids: pa.Array, h: np.ndarray) -> np.ndarray:
        known = ids.fill_null(0).to_numpy()
        low, high = (np.searchsorted(cuts, known, side=s) for s in ("left", "right"))
        low = np.where(high > low + 1, low + 1, high)
        none = ids.is_null().to_numpy(zero_copy_only=False)
        low, high = np.where(none, len(cuts) + 1, low), np.where(none, len(cuts) + nameless, high)
        return low + (h.astype(float) / 2**63 * (high - low + 1)).astype(np.int64)

    def only_parts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(b.column(0), b.column(1).to_numpy())), b.column(0), b.column(1)], ["part", "id", "h"])

    least = source.select("id", "h").mapInArrow(only_parts, "part long, id long, h long").groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("m"))
    rows = sorted((r.part, r.m.id, r.m.h) for r in least.collect())  # one row a part, so at most most_parts and one
    heads = {row[1:]: (row[0], rows[k - 1][0]) for k, row in enumerate(rows)}

    def deal(batches):
        for b in batches:
            ids, part = b.column(0), part_of(b.column(0), b.column(1).to_numpy())
            keys = zip(ids.to_pylist(), b.column(1).to_pylist(), strict=True)
            lead = [(k, heads[i][1]) for k, i in enumerate(keys) if i in heads and heads[i][0] == part[k]]
            take = pa.array([*range(b.num_rows), *(k for k, _ in lead)], pa.int64())
            to = pa.array(np.concatenate((part, [p for _, p in lead])).astype(np.int64))
            tail = pa.array([False] * b.num_rows + [True] * len(lead))
            yield pa.RecordBatch.from_arrays([to, *(c.take(take) for c in b.columns), tail], ["part", "id", "h", "text", "tail"])

    dealt = source.mapInArrow(deal, "part long, id long, h long, text string, tail boolean")
    dealt = dealt.repartition(len(rows), "part").sortWithinPartitions("part", "tail", F.col("id").asc_nulls_last(), "h", "text")
    return dealt.mapInPandas(_follow(cells), names).withColumnRenamed("id", id_col)
