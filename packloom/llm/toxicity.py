"""Toxic spans by a linear-chain conditional random field.

Labels mark whole documents, so tokens are labelled first: in a toxic document
the words whose odds are far higher among toxic documents, in a clean one
nothing. A two-label CRF (clean, toxic) is trained on windows of these tokens;
forward-backward gives every token's marginal, and the marginals of a document
aggregate to its score and its offending offsets.

Words without weights of their own share one transfer matrix; a run of k of
them is its k-th power. Forward and backward messages are thus exact over
whole texts of any length at the price of the weighted tokens alone.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, remainder, stage_table

_TOKEN = re.compile(r"[^\W\d_]+")
_SPAN = 32
_CHUNK = 8_192


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _words_once(batches):
    """(text, label) -> distinct words with the label, each batch pre-counted."""
    for b in batches:
        seen: dict[str, list[int]] = {}
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in set(_tokens(text or "")):
                c = seen.setdefault(w, [0, 0])
                c[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())] + [pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1)], ["word", "clean", "toxic"])


class Crf:
    """Two labels; emission of toxic over clean: ``bias`` plus the word's
    weight; transitions relative to clean-clean."""

    def __init__(self, vocabulary: list[str]):
        self.index = {w: k + 1 for k, w in enumerate(vocabulary)}
        # Emissions (0: unknown words), then transitions clean-toxic, toxic-clean, toxic-toxic.
        self.theta = np.zeros(len(vocabulary) + 4)
        self.theta[0] = -3.0
        self.calibration = np.zeros(3)
        self.prior = 0.5

    def _parts(self, theta):
        emit = np.concatenate(([theta[0]], theta[0] + theta[1:-3]))
        return emit, np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])

    def gradient(self, theta, ids, y, real, weight=None):
        """Mean negative log-likelihood of windows and its gradient; ``ids``,
        ``y`` and ``real`` are windows x _SPAN, ``weight`` counts equal windows.
        Messages are scaled to sum to one at each token."""
        emit, trans = self._parts(np.clip(theta, -60, 60))
        (_, s01), (s10, s11) = np.exp(trans)
        m, n = ids.shape
        weight = np.ones(m) if weight is None else weight
        ids, y, live = ids.T, y.T, real.T
        e = np.exp(emit)[ids]
        a1 = np.empty((n, m))  # P(toxic | tokens so far)
        a1[0] = e[0] / (1 + e[0])
        log_z = np.log1p(e[0])
        for t in range(1, n):
            a = a1[t - 1]
            clean, toxic = 1 - a + a * s10, ((1 - a) * s01 + a * s11) * e[t]
            total = clean + toxic
            a1[t] = np.where(live[t], toxic / total, a)
            log_z += np.where(live[t], np.log(total), 0)
        back = np.full(m, 0.5)  # the backward message of toxic; that of clean is the rest
        grad = np.zeros_like(theta)
        pairs = np.zeros(3)
        d = np.empty((n, m))
        for t in range(n - 1, -1, -1):
            a = a1[t]
            p = a * back / (a * back + (1 - a) * (1 - back))
            d[t] = (p - y[t]) * live[t] * weight
            if t:
                b = a1[t - 1]
                x01, x10, x11 = (1 - b) * s01 * e[t] * back, b * s10 * (1 - back), b * s11 * e[t] * back
                total = (1 - b) * (1 - back) + x01 + x10 + x11
                w = live[t] * weight
                before = y[t - 1]
                for q, (x, i, j) in enumerate(((x01, 0, 1), (x10, 1, 0), (x11, 1, 1))):
                    pairs[q] += ((x / total - ((before == i) & (y[t] == j))) * w).sum()
                toxic, clean = s10 * (1 - back) + s11 * e[t] * back, 1 - back + s01 * e[t] * back
                back = np.where(live[t], toxic / (toxic + clean), back)
        gold = (emit[ids] * y * live).sum(0)
        moves = live[1:] * trans[y[:-1], y[1:]]
        gold = gold + moves.sum(0)
        grad[0] = d.sum()
        grad[1:-3] = np.bincount(ids.ravel(), d.ravel(), minlength=len(theta) - 3)[1:]
        grad[-3:] = pairs
        return ((log_z - gold) * weight).sum() / weight.sum(), grad / weight.sum()

    def train(self, loss, rounds: int = 60, l2: float = 1e-5, memory: int = 8):
        """L-BFGS; ``loss`` gives the mean loss and its gradient at theta."""

        def full(theta):
            f, g = loss(theta)
            return f + l2 / 2 * theta @ theta, g + l2 * theta

        f, g = full(self.theta)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            q, alphas = g.copy(), []
            for s, y in reversed(steps):
                alphas.append((s @ q) / (s @ y))
                q -= alphas[-1] * y
            if steps:
                s, y = steps[-1]
                q *= (s @ y) / (y @ y)
            else:
                q /= max(np.abs(q).max(), 1e-12)
            for (s, y), a in zip(steps, reversed(alphas), strict=True):
                q += (a - (y @ q) / (s @ y)) * s
            rate, slope = 1.0, g @ q
            while True:
                new = self.theta - rate * q
                f2, g2 = full(new)
                if f2 <= f - 1e-4 * rate * slope or rate < 1e-3:
                    break
                rate /= 3
            s, y = new - self.theta, g2 - g
            done = f - f2 < 1e-6 * abs(f)
            if f2 < f:
                self.theta, f, g = new, f2, g2
            if done:
                break
            if s @ y > 1e-12:
                steps = [*steps[1 - memory :], (s, y)]

    def ready(self):
        """What inference needs, as plain floats: powers by eigenvalues."""
        emit, trans = self._parts(self.theta)
        self.emit = np.exp(np.clip(emit, -60, 60)).tolist()
        self.step = np.exp(np.clip(trans, -60, 60))
        quiet = self.step * np.array([1.0, self.emit[0]])
        self.values, self.vectors = np.linalg.eig(quiet)
        self.values, self.vectors = self.values.real, self.vectors.real
        self.inverse = np.linalg.inv(self.vectors)
        self.powers: dict[int, list] = {}
        return self

    def _run(self, k: int) -> list:
        """k quiet tokens, up to a factor."""
        if k not in self.powers:
            if len(self.powers) > 100_000:
                self.powers.clear()
            ratio = self.values / np.abs(self.values).max()
            self.powers[k] = ((self.vectors * ratio**k) @ self.inverse).ravel().tolist()
        return self.powers[k]

    def marginals(self, n: int, at: list[int], ids: list[int]) -> list[float]:
        """P(toxic) of the tokens at positions ``at`` (with weights ``ids``) of
        a text of n tokens."""
        return self._messages(n, at, ids)[0]

    def tagged(self, n: int, at: list[int], ids: list[int]) -> dict[int, float]:
        """Tokens whose P(toxic) is above one half: those with weights, and the
        quiet ones that join on to them."""
        p, forward, back = self._messages(n, at, ids)
        s00, s01, s10, s11 = self.step.ravel().tolist()
        e0 = self.emit[0]
        out = {}
        for i, q in enumerate(p):
            if q <= 0.5:
                continue
            out[at[i]] = q
            gap = (at[i + 1] if i + 1 < len(at) else n) - at[i] - 1
            ahead = (1.0, 1.0)
            if i + 1 < len(at):
                e, z = self.emit[ids[i + 1]], back[i + 1]
                ahead = (s00 * z[0] + s01 * e * z[1], s10 * z[0] + s11 * e * z[1])
            a = forward[i]
            for k in range(1, gap + 1):
                a = (a[0] * s00 + a[1] * s10, (a[0] * s01 + a[1] * s11) * e0)
                a = (a[0] / (a[0] + a[1]), a[1] / (a[0] + a[1]))
                m = self._run(gap - k) if gap > k else (1, 0, 0, 1)
                z = (m[0] * ahead[0] + m[1] * ahead[1], m[2] * ahead[0] + m[3] * ahead[1])
                here = a[1] * z[1] / (a[0] * z[0] + a[1] * z[1])
                if here <= 0.5:
                    break
                out[at[i] + k] = here
            gap = at[i] - (at[i - 1] + 1 if i else 0)
            e, z = self.emit[ids[i]], back[i]
            z = (s00 * z[0] + s01 * e * z[1], s10 * z[0] + s11 * e * z[1])
            for k in range(1, gap + 1):
                start, j = (forward[i - 1], gap - k + 1) if i else ((1.0, e0), gap - k)
                m = self._run(j) if j else (1, 0, 0, 1)
                a = (start[0] * m[0] + start[1] * m[2], start[0] * m[1] + start[1] * m[3])
                here = a[1] * z[1] / (a[0] * z[0] + a[1] * z[1])
                if here <= 0.5:
                    break
                out[at[i] - k] = here
                z = (s00 * z[0] + s01 * e0 * z[1], s10 * z[0] + s11 * e0 * z[1])
                z = (z[0] / (z[0] + z[1]), z[1] / (z[0] + z[1]))
        return out

    def _messages(self, n: int, at: list[int], ids: list[int]):
        s = self.step.ravel().tolist()
        forward, back = [], [(1.0, 1.0)] * len(at)
        last = -1
        a = None
        for p, k in zip(at, ids, strict=True):
            e = self.emit[k]
            if a is None:
                if p:
                    c, d = 1.0, self.emit[0]
                    q = self._run(p - 1) if p > 1 else [1, 0, 0, 1]
                    c, d = c * q[0] + d * q[2], c * q[1] + d * q[3]
                    a = (c * s[0] + d * s[2], (c * s[1] + d * s[3]) * e)
                else:
                    a = (1.0, e)
            else:
                q = self._run(p - last - 1) if p - last > 1 else [1, 0, 0, 1]
                c, d = a[0] * q[0] + a[1] * q[2], a[0] * q[1] + a[1] * q[3]
                a = (c * s[0] + d * s[2], (c * s[1] + d * s[3]) * e)
            t = a[0] + a[1]
            a = (a[0] / t, a[1] / t)
            forward.append(a)
            last = p
        z = (1.0, 1.0)
        nxt = n
        for i in range(len(at) - 1, -1, -1):
            gap = nxt - at[i] - 1
            if nxt < n:
                e = self.emit[ids[i + 1]]
                z = (s[0] * z[0] + s[1] * e * z[1], s[2] * z[0] + s[3] * e * z[1])
            if gap > 0:
                q = self._run(gap)
                z = (q[0] * z[0] + q[1] * z[1], q[2] * z[0] + q[3] * z[1])
            t = z[0] + z[1]
            z = (z[0] / t, z[1] / t)
            back[i] = z
            nxt = at[i]
        out = []
        for (a0, a1), (z0, z1) in zip(forward, back, strict=True):
            out.append(a1 * z1 / (a0 * z0 + a1 * z1))
        return out, forward, back

    def aggregates(self, text: str):
        """(log odds of the largest marginal, expected toxic tokens), and what
        ``tagged`` takes if any marginal is above one half."""
        words = _tokens(text)
        ids = list(map(self.index.get, words))
        at = [k for k, v in enumerate(ids) if v] if any(ids) else []
        if not at:
            return -12.0, 0.0, None
        which = (len(words), at, [ids[k] for k in at])
        p = self.marginals(*which)
        top = min(max(max(p), 1e-6), 1 - 1e-6)
        return math.log(top / (1 - top)), sum(p), which if top > 0.5 else None

    def probability(self, top: float, total: float) -> float:
        a, b, c = self.calibration
        return 1 / (1 + math.exp(-min(max(a + b * top + c * math.log1p(total), -30), 30)))


def _windows(index: dict[str, int], positive: set[int]):
    """(text, label) -> the text in windows of _SPAN tokens, each token once."""

    def run(batches):
        for b in batches:
            out = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = [index.get(w, 0) for w in _tokens(text or "")]
                for a in range(0, len(ids), _SPAN):
                    x = ids[a : a + _SPAN]
                    marks = sum(1 << k for k, v in enumerate(x) if v in positive) if y == 1 and any(x) else 0
                    out.append((np.array(x + [0] * (_SPAN - len(x)), np.int32).tobytes(), marks, len(x)))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["ids", "y", "n"])

    return run


def _arrays(ids, y, n):
    """Packed windows -> what ``Crf.gradient`` takes."""
    at = np.arange(_SPAN)
    return np.frombuffer(b"".join(ids), np.int32).reshape(-1, _SPAN), (np.asarray(y)[:, None] >> at) & 1, at < np.asarray(n)[:, None]


def _mean_loss(crf: Crf, rows: DataFrame, on_driver: int):
    """Mean loss and gradient over all windows (ids, y, n, weight): on the
    driver if they are few, else summed by the executors, one row a task."""
    size = rows.agg(F.count("*").alias("rows"), F.sum("weight").alias("weight")).first()

    def summed(model, now, parts):
        f, g = 0.0, np.zeros_like(now)
        for ids, y, real, weight in parts:
            f2, g2 = model.gradient(now, ids, y, real, weight)
            f, g = f + f2 * weight.sum(), g + g2 * weight.sum()
        return f, g

    if size.rows <= on_driver:
        got = rows.orderBy("ids", "y", "n").collect()
        parts = []
        for k in range(0, len(got), _CHUNK):
            c = got[k : k + _CHUNK]
            parts.append((*_arrays([r["ids"] for r in c], [r["y"] for r in c], [r["n"] for r in c]), np.array([r["weight"] for r in c], float)))

        def here(theta):
            f, g = summed(crf, theta, parts)
            return f / size.weight, g / size.weight

        return here

    spark = rows.sparkSession

    def total(theta):
        sent = spark.sparkContext.broadcast((crf, theta))

        def each(batches):
            model, now = sent.value
            cut = (b.slice(k, _CHUNK) for b in batches for k in range(0, b.num_rows, _CHUNK))
            parts = ((*_arrays(c.column(0).to_pylist(), c.column(1).to_numpy(), c.column(2).to_numpy()), c.column(3).to_numpy().astype(float)) for c in cut)
            f, g = summed(model, now, parts)
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([g.tobytes()], pa.binary())], ["f", "g"])

        got = rows.mapInArrow(each, "f double, g binary").collect()
        sent.destroy()
        return sum(r.f for r in got) / size.weight, sum(np.frombuffer(r.g) for r in got) / size.weight

    return total


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(train: DataFrame, least: int = 3, odds: float = 8.0, on_driver: int = 200_000) -> Crf:
    """From rows (text string, label int), which must be bounded in number."""
    totals = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        crf = Crf([]).ready()
        share = 0.5 if not totals else 0.01 if totals.get(0) else 0.99
        crf.calibration = np.array([math.log(share / (1 - share)), 0, 0])
        return crf
    counts = train.mapInArrow(_words_once, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = (F.col("toxic") / F.lit(totals[1])) / ((F.col("clean") + 0.5) / F.lit(totals[0]))
    counts = counts.where(F.col("toxic") >= least).withColumn("ratio", ratio).where("ratio >= 2")
    words = counts.orderBy("word").toPandas()  # bounded by the sample
    crf = Crf(words["word"].tolist())
    positive = {crf.index[w] for w, r in zip(words["word"], words["ratio"], strict=True) if r >= odds}
    rows = train.mapInArrow(_windows(crf.index, positive), "ids binary, y long, n int")
    rows = stage_table(rows.groupBy("ids", "y", "n").agg(F.count("*").alias("weight")), "windows")
    if not rows.isEmpty():
        crf.train(_mean_loss(crf, rows, on_driver))
    drop_table(rows)
    crf.ready()

    def measured(frames):
        for f in frames:
            got = [crf.aggregates(t or "")[:2] for t in f["text"]]
            yield pd.DataFrame({"top": [g[0] for g in got], "total": [g[1] for g in got], "label": f["label"].to_numpy()})

    seen = train.mapInPandas(measured, "top double, total double, label int").toPandas()
    x = np.column_stack([np.ones(len(seen)), seen["top"], np.log1p(seen["total"])])
    crf.calibration = _logistic(x, seen["label"].to_numpy(float))
    return crf


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    held_out: tuple[int, int] = (3, 1),
    threshold: float = 0.7,
    sample_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every document; labels are learnt from rows whose crc32(id as
    text) mod ``held_out[0]`` is not ``held_out[1]``, from at most
    ``sample_rows`` of them (those whose ids hash lowest), which are read whole:
    every window of every text counts. That is the only bound.

    Returns per row of ``docs``: id_col, held_out boolean, score double (0 to
    1), predicted int (1 if score >= threshold), spans array<struct<start,
    end, p>> of toxic words (marginal over one half: words with weights and
    the ordinary ones that join on to them; code points). Only the
    text is an input. Null texts are empty; texts without weighted words share
    the lowest score. Null ids are scored, never learnt from. Null labels are
    skipped; ties of the sample are cut by id. Repeated rows are repeated and
    count. Other columns, whatever their names, are ignored. Empty input: no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = source.withColumn("held_out", remainder("id", held_out[0]) == held_out[1])
    kind = source.schema["id"].dataType.simpleString()
    marks = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(remainder("id", held_out[0]) != held_out[1]).where("id is not null and label in (0, 1)").distinct()
    marks = F.broadcast(marks.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows))  # bounded by sample_rows
    train = stage_table(source.join(marks, "id").select("text", "label"), "labelled")
    model = docs.sparkSession.sparkContext.broadcast(fit(train))
    drop_table(train)

    def scored(batches):
        crf = model.value
        for b in batches:
            score, spans = [], []
            for text in b.column(1).fill_null("").to_pylist():
                top, total, which = crf.aggregates(text)
                score.append(crf.probability(top, total))
                found = []
                if which:
                    bad, low = crf.tagged(*which), text.lower()
                    # lower() may have changed the length.
                    back = None if len(low) == len(text) else np.cumsum([0, *(len(ch.lower()) for ch in text)])
                    for k, m in enumerate(_TOKEN.finditer(low)):
                        if k in bad:
                            a, z = m.span() if back is None else np.searchsorted(back, m.span()).tolist()
                            found.append({"start": a, "end": z, "p": bad[k]})
                spans.append(found)
            s = np.array(score, float)
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            cols = [b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "score", "predicted", "spans"])

    out = source.mapInArrow(scored, f"id {kind}, held_out boolean, score double, predicted int, spans array<struct<start: bigint, end: bigint, p: double>>")
    return out.withColumnRenamed("id", id_col)

