"""Quality classifier: random Fourier features over document statistics.

Statistics of each text are computed map-side, from its bytes. Random
Fourier features approximate a Gaussian kernel over the standardised
statistics; ridge weights come from normal equations that every partition sums
on its own (their size depends on the number of features alone); an isotonic
map over binned scores calibrates them to probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, remainder, stage_table, text_chunks, words_of

# Byte classes: upper, lower, digit, sentence marks, exclamation, bar, other
# symbols, space, line feed, non-ASCII, rest.
_CLASS = np.full(256, 10, np.int64)
_CLASS[128:] = 9
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?", b"!", b"|", b"#$%&*+/<=>@\\^_`{}~[]", b" \t", b"\n\r")):
    _CLASS[list(_chars)] = _k
N_STATS = 20


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``N_STATS`` numbers per text; all finite, also for empty ones."""
    out = []
    for i, j, data, offs in text_chunks(column):
        m = j - i
        size = np.diff(offs).astype(float)
        owner = np.repeat(np.arange(m), np.diff(offs))
        by = np.bincount(owner * 11 + _CLASS[data], minlength=11 * m).reshape(m, 11).astype(float)
        h, doc, start = words_of(data, offs)
        n = np.bincount(doc, minlength=m).astype(float)
        some, ink = np.maximum(n, 1), np.maximum(size - by[:, 7] - by[:, 8], 1)
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        distinct = np.bincount(ds[new], minlength=m)
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        top = np.zeros(m)
        np.maximum.at(top, ds[new], runs)
        again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=m)
        # Words' lengths: from a start to the next start, less the white space.
        end = np.append(start[1:], len(data))
        end = np.minimum(end, offs[doc + 1])
        length = end - start - 1
        short, long = (np.bincount(doc[x], minlength=m) for x in (length <= 3, length > 12))
        squares = np.bincount(doc, length.astype(float) ** 2, minlength=m)
        letters = np.maximum(by[:, 0] + by[:, 1] + by[:, 9], 1)
        share = by / np.maximum(size, 1)[:, None]
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
        mean = ink / some
        out.append(
            np.column_stack(
                [
                    np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(squares / some - (length_mean := np.bincount(doc, length, minlength=m) / some) ** 2, 0)),
                    by[:, 0] / letters, by[:, 2] / ink, by[:, 3] / some, by[:, 4] / some, by[:, 5] / some, by[:, 6] / some,
                    np.log1p(by[:, 8]) - np.log1p(n), by[:, 9] / letters, by[:, 10] / some, distinct / some, np.log1p(distinct) / np.log1p(some),
                    top / some, again / some, short / some, long / some, entropy + 0 * length_mean,
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, N_STATS))


def _measured(batches):
    for b in batches:
        x = statistics(b.column(1))
        values = pa.array(x.ravel(), pa.float64())
        stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([b.column(0), stats, b.column(2)], ["id", "stats", "held_out"])


class _Model:
    """Standardisation, random features, weights and calibration."""

    def __init__(self, features: int, seed: int, bandwidth: float):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(size=(N_STATS, features)) / (bandwidth * np.sqrt(N_STATS))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.mean, self.scale = np.zeros(N_STATS), np.ones(N_STATS)
        self.weights = np.zeros(features + 1)
        self.at, self.to = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        # A trace of the raw score keeps the order inside a flat step.
        return np.clip(0.998 * np.interp(r, self.at, self.to) + 0.002 / (1 + np.exp(-np.clip(4 * r - 2, -30, 30))), 0, 1)


def _summed(df: DataFrame, part, size: int, lanes: int = 16) -> np.ndarray:
    """Sum of ``part(x, y)`` over the rows of (stats, label), in two levels: at
    most ``lanes`` vectors of ``size`` reach the driver."""

    def local(frames):
        total, seen = np.zeros(size), 0
        for f in frames:
            if len(f):
                total += part(np.stack(f["stats"].to_numpy()), f["label"].to_numpy(float))
                seen += len(f)
        if seen:
            yield pd.DataFrame({"v": [total.tobytes()]})

    def joined(pdf):
        return pd.DataFrame({"v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    rows = df.mapInPandas(local, "v binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    got = rows.groupBy("lane").applyInPandas(joined, "v binary").collect()
    return np.sum([np.zeros(size), *(np.frombuffer(r.v) for r in got)], axis=0)


def _isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins in order of score."""
    blocks: list[list[float]] = []
    for a, p in zip(n, positive, strict=True):
        blocks.append([a, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            a2, p2, k2 = blocks.pop()
            blocks[-1][0] += a2
            blocks[-1][1] += p2
            blocks[-1][2] += k2
    return np.concatenate([np.full(int(k), p / a) for a, p, k in blocks]) if blocks else np.zeros(0)


def fit(train: DataFrame, features: int = 256, ridge: float = 0.1, bandwidth: float = 2.0, bins: int = 2048, seed: int = 8) -> _Model:
    """Fit on rows (stats array<double>, label double). Without rows of both
    labels the model scores every text alike (0.5, or the only label)."""
    model = _Model(features, seed, bandwidth)
    s = _summed(train, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * N_STATS)
    if not 0 < s[1] < s[0]:
        model.to = np.array([s[1] / s[0] if s[0] else 0.5])
        return model
    model.mean = s[2 : 2 + N_STATS] / s[0]
    model.scale = np.sqrt(np.maximum(s[2 + N_STATS :] / s[0] - model.mean**2, 1e-12))
    model.scale[model.scale < 1e-5] = 1
    d = features + 1

    def normal(x, y, m=model):
        f = m.features(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    s = _summed(train, normal, d * d + d)
    gram = s[: d * d].reshape(d, d)
    model.weights = np.linalg.solve(gram + ridge * gram[-1, -1] / d * np.eye(d), s[d * d :])

    def binned(x, y, m=model):
        k = np.clip(((m.raw(x) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(k, minlength=bins), np.bincount(k, y, bins)])

    s = _summed(train, binned, 2 * bins)
    used = np.flatnonzero(s[:bins])
    model.at = (used + 0.5) / bins * 2 - 0.5
    model.to = _isotonic(s[:bins][used], s[bins:][used])
    return model


def _learnt(measured: DataFrame, labels: DataFrame, label: str, id_col: str):
    """Broadcast model from rows (id, stats, held_out, ...) and labels by id."""
    marks = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"))
    train = stage_table(measured.where("not held_out").select("id", "stats").join(marks, "id").select("stats", "label"), "training")
    model = measured.sparkSession.sparkContext.broadcast(fit(train))
    drop_table(train)
    return model


def _measure(docs: DataFrame, held_out: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(id, stats, held_out)"""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = source.withColumn("held_out", remainder("id", held_out[0]) == held_out[1])
    kind = source.schema["id"].dataType.simpleString()
    return stage_table(source.mapInArrow(_measured, f"id {kind}, stats array<double>, held_out boolean"), "statistics")


def good_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (5, 0), threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that ``quality_scores`` would
    predict 1. Null and empty texts share one score, so all of them stay or
    go; so do equal texts. Null ids are judged like others, repeated rows stay
    repeated, other columns may have any names. Without labels of both kinds
    every text has one score. Empty input: no rows."""
    # Texts are measured twice: a table of whole rows would lie on the disk until
    # the caller has read the result.
    measured = _measure(docs, held_out, id_col, text_col)
    model = _learnt(measured, labels, label, id_col)
    drop_table(measured)

    def run(batches):
        for b in batches:
            yield b.select(names).filter(pa.array(model.value.score(statistics(b.column(0))) >= threshold))

    names = [f"c{k}" for k in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    source = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(n) for n, c in zip(names, docs.columns, strict=True)))
    return source.mapInArrow(run, kinds).toDF(*docs.columns)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    held_out: tuple[int, int] = (5, 0),
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every document; labels are learnt from rows whose crc32(id as
    text) mod ``held_out[0]`` is not ``held_out[1]``.

    Returns per row of ``docs``: id_col, held_out boolean, score double (0 to
    1), predicted int (1 if score >= threshold). Only the text is an input of a
    score. Null texts are empty; an empty text gets the score of its (all zero) statistics. Null
    ids are scored, never learnt from. Null labels are skipped; an id with
    several labels counts once for each. Empty input: no rows.
    """
    measured = _measure(docs, held_out, id_col, text_col)
    model = _learnt(measured, labels, label, id_col)
    kind = measured.schema["id"].dataType.simpleString()

    def scored(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, N_STATS)
            s = model.value.score(x)
            cols = [b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "score", "predicted"])

    out = measured.mapInArrow(scored, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
