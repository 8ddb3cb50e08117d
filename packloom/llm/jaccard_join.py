"""Set-similarity self-join on word shingles: grouped prefix join.

The method (a GroupJoin): shingles get one global order; two sets of Jaccard
similarity t or more must share l shingles among the first
``n - ceil(t n) + l`` of each (one would do, but unrelated texts share one
by chance all too often as a corpus grows; l is three, more for long texts). Documents with
identical prefixes and sizes collapse into one group, pairs of groups are
filtered by size and position, then groups expand into members and full sets
are compared.

Global order. Shingle hashes are uniform, so "by hash" samples every set
evenly; shingles common in the corpus go behind the rare ones, by steps of
their counts (a byte in a table of bounded size, where two shingles may share
a cell), so that boilerplate makes no long posting lists. Prefixes only ever
come from the low end of the hash range, so only that end is counted and
shuffled ("low": 2.5 times the prefix's share of a set). Any order gives exact
results; the counts only make it fast.

Nothing is lost on large groups and nothing is quadratic in them: exact copies
are one class from the start; a posting list gives a few pairs for each of its
groups or, if more may match, a forest; one longer than ``long_list`` links
its groups into a chain by size, which puts every pair that may match into the
same candidate component at linear cost (a shingle in more than ``hub_list``
sets has no list at all, its groups link to a node that stands for it and a
step of set size). Components are then joined exactly in memory - prefixes once
more, now in the order that suits these sets best, then pivots: copies of one
text need one pivot - in tasks of bounded size: a component that is too big for one task is cut into blocks and every
pair of blocks that may match is its own task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chain, drop_table, free_name, free_shuffles, shuffles_end, stage_table, text_chunks, words_of
from .components import components


def _shared(t_num: int, t_den: int) -> int:
    """Shingles that matching sets are asked to share in their prefixes: three,
    or as many as any two different sets that match have in common, if less."""
    return min(3, max(1, -(-t_num // max(t_den - t_num, 1))))


def _sets(column: pa.Array, n: int):
    """Each text's shingle set as a sorted array of 64-bit hashes."""
    for i, j, data, offs in text_chunks(column):
        h, doc, _ = words_of(data, offs)
        s = chain(h, n)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(j - i):
            a, z = cut[k], cut[k + 1]
            if z - a >= n:
                x = np.sort(s[a : z - n + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            else:
                yield chain(h[a:z], z - a) if z > a else np.zeros(0, np.uint64)


def _need(n, t_num: int, t_den: int):
    """ceil(t n): the overlap that a set of n needs with any partner."""
    return -(-n * t_num // t_den)


def _asked(n, t_num: int, t_den: int):
    """Shingles that a set of n and a matching one of n or more share in their
    prefixes. Long sets are asked for an eighth of what may differ: by chance
    they have more than three in common with many others."""
    return np.maximum(_shared(t_num, t_den), np.minimum(_need(n, t_num, t_den), n * (t_den - t_num) // (8 * t_den)))


def _prefix_length(n, t_num: int, t_den: int):
    """Any two matching sets share what ``_asked`` says of the smaller one in
    prefixes this long, save sets that small that only equal ones match."""
    return n - _need(n, t_num, t_den) + int(_asked(n, t_num, t_den))


def _fingerprint(x: np.ndarray) -> int:
    """Of a whole set, signed for Spark's long."""
    with np.errstate(over="ignore"):
        return int((chain(np.array([x.sum(), np.bitwise_xor.reduce(x), U64(len(x))], np.uint64), 3)).view(np.int64)[0])


def _profile(n: int, t_num: int, t_den: int):
    """Rows of (id, text) -> (id, n_shingles, fp, low): fp null without words;
    low: the hashes that a prefix can need."""
    share = min(1.0, 2.5 * (1 - t_num / t_den))
    bound = U64(min(2**64 - 1, int(share * 2**64)))

    def run(batches):
        for b in batches:
            size, fp, low = [], [], []
            for x in _sets(b.column(1), n):
                size.append(len(x))
                fp.append(_fingerprint(x) if len(x) else None)
                p = _prefix_length(len(x), t_num, t_den)
                low.append(x[: max(int(np.searchsorted(x, bound)), p)].tobytes() if len(x) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(low, pa.binary())], ["id", "n_shingles", "fp", "low"])

    return run


def _partial_counts(buckets: int, bound: int):
    """Counts of low hashes, pre-aggregated over a batch, one row a bucket."""

    def run(batches):
        for b in batches:
            h = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            h, c = np.unique(h[h < U64(bound)], return_counts=True)
            which = (h % U64(buckets)).astype(np.int64)
            o = np.argsort(which, kind="stable")
            cut = np.searchsorted(which[o], np.arange(buckets + 1))
            rows = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32())] + [pa.array([x[o[cut[k] : cut[k + 1]]].tobytes() for k in rows], pa.binary()) for x in (h, c.astype(np.uint32))],
                ["bucket", "h", "c"],
            )

    return run


def _summed(buckets: int, per: int, least: int, hub_list: int):
    """One row for a bucket: its cells, each the largest step of count (0 under
    ``least``) of the hashes that share it, and its hubs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["h"]), np.uint64)
        c = np.frombuffer(b"".join(pdf["c"]), np.uint32)
        o = np.argsort(h, kind="stable")
        h, c = h[o], c[o].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        h, c = h[first], np.add.reduceat(c, first)
        h, c = h[c >= least], c[c >= least]
        cells = np.zeros(per, np.uint8)
        np.maximum.at(cells, (h // U64(buckets) % U64(per)).astype(np.int64), np.maximum(1, np.log2(c) * 4).astype(np.uint8))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1].to_numpy(), "cells": [zlib.compress(cells.tobytes(), 1)], "hubs": [h[c > hub_list].tobytes()]})

    return run


def _common(low: DataFrame, buckets: int, bound: int, least: int, hub_list: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps of count of all low hashes, a row of cells for each bucket, and the
    hashes in more than ``hub_list`` sets, in order. At most ``most`` cells."""
    per = max(1, min(1 << 18, most // buckets))
    counts = low.mapInArrow(_partial_counts(buckets, bound), "bucket int, h binary, c binary")
    cells, hubs = np.zeros((buckets, per), np.uint8), [np.zeros(0, np.uint64)]
    with shuffles_end(low.sparkSession):
        rows = counts.groupBy("bucket").applyInPandas(_summed(buckets, per, least, hub_list), "bucket int, cells binary, hubs binary").collect()
    for r in rows:
        cells[r.bucket] = np.frombuffer(zlib.decompress(r.cells), np.uint8)
        hubs.append(np.frombuffer(r.hubs, np.uint64))
    return cells, np.sort(np.concatenate(hubs))


class _Order:
    """The global order: low rare shingles by hash, low common ones by step of
    count, then the rest by hash."""

    def __init__(self, cells: np.ndarray, bound: int):
        self.cells, self.bound = cells, U64(bound)

    def prefix(self, low: np.ndarray, p: int) -> np.ndarray:
        end = int(np.searchsorted(low, self.bound))
        x = low[:end]
        buckets, per = (U64(k) for k in self.cells.shape)
        step = self.cells[(x % buckets).astype(np.int64), (x // buckets % per).astype(np.int64)]
        rare = x[step == 0]
        if len(rare) >= p:
            return rare[:p]
        x = x[np.argsort(step, kind="stable")]
        return x[:p] if len(x) >= p else np.concatenate((x, low[end:]))[:p]


def _prefixed(order, t_num, t_den):
    """(fp, n, low) -> (fp, n, grp, prefix): each class's group is named by
    its size and prefix."""

    def run(batches):
        for b in batches:
            names, prefixes = [], []
            for n, low in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                p = order.value.prefix(np.frombuffer(low, np.uint64), _prefix_length(n, t_num, t_den))
                prefixes.append(p.tobytes())
                names.append((n, p[0], np.bitwise_xor.reduce(p), p.sum()))
            k = np.array(names, np.uint64).reshape(-1, 4)
            grp = chain(k.ravel(), 4)[::4].view(np.int64) if len(k) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grp), pa.array(prefixes, pa.binary())], ["fp", "n", "grp", "prefix"])

    return run


_ENTRY = [("h", "<u8"), ("g", "<i8"), ("n", "<i4"), ("at", "<i4")]


def _entries(batch) -> np.ndarray:
    """(n, grp, prefix) -> one entry per shingle of each group's prefix."""
    n, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    _, first = np.unique(g, return_index=True)
    prefixes = batch.column(2).to_pylist()
    size = np.array([len(prefixes[i]) // 8 for i in first], np.int64)
    e = np.empty(size.sum(), _ENTRY)
    e["h"] = np.frombuffer(b"".join(prefixes[i] for i in first), np.uint64)
    e["g"], e["n"] = np.repeat(g[first], size), np.repeat(n[first], size)
    e["at"] = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
    return e


def _postings(hubs, buckets):
    """Prefix entries of each group, packed by bucket; hubs aside."""

    def run(batches):
        for b in batches:
            e = _entries(b)
            if len(hubs.value):
                e = e[~np.isin(e["h"], hubs.value)]
            which = (e["h"] % U64(buckets)).astype(np.int64)
            o = np.argsort(which, kind="stable")
            cut = np.searchsorted(which[o], np.arange(buckets + 1))
            rows = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([e[o[cut[k] : cut[k + 1]]].tobytes() for k in rows], pa.binary())], ["bucket", "e"])

    return run


def _hubs(hubs, t_num, t_den):
    """Edges from a group to a node for each hub of its prefix and step of set
    size. Two sizes that may match are in the same step or in neighbouring
    ones, so each group goes to its step and the next: no list of the hub's
    groups is ever made."""
    base = math.log(t_den / t_num) if t_num < t_den else 1e-9

    def run(batches):
        for b in batches:
            e = _entries(b) if len(hubs.value) else np.zeros(0, _ENTRY)
            e = e[np.isin(e["h"], hubs.value)]
            step = np.floor(np.log(e["n"]) / base).astype(np.uint64)
            v = [chain(np.column_stack((e["h"], step + U64(k))).ravel(), 2)[::2].view(np.int64) if len(e) else e["g"] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((e["g"], e["g"]))), pa.array(np.concatenate(v))], ["u", "v"])

    return run


def _union(m: int):
    parent = list(range(m))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    return parent, find


#: Weight of a pair that stands for others: enough, whatever is asked for.
_ENOUGH = 1 << 32
#: Pairs that a list gives for each of its groups, at most.
_PAIRS = 4


def _near(h, g, n, at, t_num: int, t_den: int, long_list: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From prefix entries: pairs of groups that connect whatever may match,
    with weights and the smaller size. A list gives every pair that sizes and
    positions allow a weight of one, if they are at most ``_PAIRS`` times its
    groups. Else a spanning forest of them is kept, of a list longer than
    ``long_list`` a chain by size; these have ``_ENOUGH`` weight on their own."""
    o = np.lexsort((g, n, h))
    h, g, n, at = h[o], g[o], n[o].astype(np.int64), at[o].astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    h, g, n, at = h[new], g[new], n[new], at[new]
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
    size = np.diff(edge)
    us, vs, ws = ([np.zeros(0, np.int64)] for _ in range(3))

    def add(i, j, weight):
        us.append(i)
        vs.append(j)
        ws.append(np.full(len(i), weight, np.int64))

    def keep(i, j):
        most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
        return (n[i] * t_den >= t_num * n[j]) & (most * t_den >= t_num * (n[i] + n[j] - most))

    for k in np.unique(size[size > 1]).tolist():
        lists = edge[:-1][size == k]
        if k > long_list:
            i = (lists[:, None] + np.arange(k - 1)).ravel()
            i = i[n[i] * t_den >= t_num * n[i + 1]]
            add(i, i + 1, _ENOUGH)
            continue
        x, y = np.triu_indices(k, 1)
        step = max(1, (1 << 20) // len(x))
        for a in range(0, len(lists), step):
            i, j = (lists[a : a + step, None] + x).ravel(), (lists[a : a + step, None] + y).ravel()
            own = np.repeat(np.arange(len(i) // len(x)), len(x))
            ok = keep(i, j)
            i, j, own = i[ok], j[ok], own[ok]
            pairs = np.bincount(own, minlength=1)
            few = (pairs <= _PAIRS * k)[own]
            add(i[few], j[few], 1)
            kept = []
            many = np.flatnonzero(~few)
            for part in np.split(many, np.flatnonzero(np.diff(own[many])) + 1) if len(many) else []:
                parent, find = _union(k)
                left, base = k - 1, lists[a + own[part[0]]]
                for z, p, q in zip(part.tolist(), (i[part] - base).tolist(), (j[part] - base).tolist(), strict=True):
                    p, q = find(p), find(q)
                    if p != q:
                        parent[q] = p
                        kept.append(z)
                        left -= 1
                        if not left:
                            break
            add(i[kept], j[kept], _ENOUGH)
    u, v = np.concatenate(us), np.concatenate(vs)
    return g[u], g[v], np.concatenate(ws), n[u]


def _candidates(t_num: int, t_den: int, long_list: int):
    """Entries of a bucket -> pairs of groups, what they share there and what
    is asked for."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.frombuffer(b"".join(pdf["e"]), _ENTRY)
        u, v, w, n = _near(e["h"], e["g"], e["n"], e["at"], t_num, t_den, long_list)
        pairs = pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v), "w": w, "asked": _asked(n, t_num, t_den)})
        return pairs.groupby(["u", "v"], as_index=False).agg({"w": "sum", "asked": "max"})

    return run


def links_among(sets: list[np.ndarray], t_num: int, t_den: int, long_list: int = 400) -> list[tuple[int, int]]:
    """Links that connect what is linked at all among ``sets``, exactly. The
    prefix filter once more, now with the order that suits these sets best
    (whole sets, rarest here first); what it leaves goes to ``links_within``."""
    m = len(sets)
    if m < 4:
        return links_within(sets, t_num, t_den)
    size = np.array([len(x) for x in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    _, token, count = np.unique(every, return_inverse=True, return_counts=True)
    o = np.lexsort((token, count[token], owner))
    at = np.arange(len(o)) - np.repeat(np.cumsum(size) - size, size)
    token, owner = token[o], owner[o]
    ok = (at < (size - _need(size, t_num, t_den) + 1)[owner]) & (count[token] > 1)
    u, v, *_ = _near(token[ok], owner[ok], size[owner[ok]], at[ok], t_num, t_den, long_list)
    parent, find = _union(m)
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        parent[find(a)] = find(b)
    members: dict[int, list[int]] = {}
    for i in np.unique(np.concatenate((u, v))).tolist():
        members.setdefault(find(i), []).append(i)
    out = []
    for part in members.values():
        out += [(part[i], part[j]) for i, j in links_within([sets[k] for k in part], t_num, t_den)]
    return out


def links_within(sets: list[np.ndarray], t_num: int, t_den: int) -> list[tuple[int, int]]:
    """Links that connect what is linked at all, exactly: pairs (i, j) such
    that any two sets joined by links are joined by returned ones.

    A pivot is compared with every set at once. Sets outside the largest
    component found so far become pivots one after the other; a pair inside it
    needs no comparison, any other has a pivot.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    parent, find = _union(m)

    def linked(i):
        k = np.searchsorted(sets[i], every)
        k[k == len(sets[i])] = 0
        both = np.bincount(owner[sets[i][k] == every], minlength=m)
        return np.flatnonzero(both * t_den >= t_num * (size + size[i] - both))

    out, done = [], np.zeros(m, bool)
    count, big = np.ones(m, np.int64), None
    middle_first = np.argsort(size, kind="stable")[np.argsort(np.abs(np.arange(m) - m // 2), kind="stable")].tolist()
    while middle_first:
        later = []
        for i in middle_first:
            if big is not None and find(i) == find(big):
                later.append(i)  # looked at again, should another component become the largest
                continue
            done[i] = True
            for j in linked(i).tolist():
                a, b = find(i), find(j)
                if a != b:
                    parent[b] = a
                    count[a] += count[b]
                    out.append((i, j))
            if big is None or count[find(i)] > count[find(big)]:
                big = i
        middle_first = later if any(find(i) != find(big) for i in later) else []
    return out


def _verified(n: int, t_num: int, t_den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("fp")
        got = links_among([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], t_num, t_den)
        fp = pdf["fp"].to_numpy()
        return pd.DataFrame({"u": [fp[i] for i, _ in got], "v": [fp[j] for _, j in got]}, dtype="int64")

    return run


def _hashes(n: int):
    """(fp, tasks, text) -> the same with the text's whole set; a text of another
    set (an id that several texts share) is left out."""

    def run(batches):
        for b in batches:
            fps, sets = b.column(0).to_pylist(), list(_sets(b.column(2), n))
            same = pa.array([len(x) > 0 and _fingerprint(x) == fp for fp, x in zip(fps, sets, strict=True)], pa.bool_())
            sets = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sets], ["fp", "tasks", "hashes"]).filter(same)

    return run


def jaccard_join(
    docs: DataFrame,
    words: int = 5,
    threshold: tuple[int, int] = (8, 10),
    id_col: str = "doc_id",
    text_col: str = "text",
    long_list: int = 400,
    hub_list: int = 100_000,
    common_least: int = 4,
    common_cells: int = 1 << 26,
    task_shingles: int = 1_000_000,
    buckets: int | None = None,
    in_one_task: int = 100_000,
) -> DataFrame:
    """Documents and the component of the similarity graph each is in.

    One row per row of ``docs``: id_col, n_shingles long, component_id (the
    smallest id reachable by links, itself included). A document's set holds
    its distinct shingles of ``words`` words (A-Z lower-cased, words are runs
    of bytes other than white space); with fewer words, the whole sequence is
    its only shingle. Two documents link when their Jaccard similarity is
    ``threshold`` (a fraction of integers) or more; comparison is in integers.

    Null or wordless texts: n_shingles 0, linked with nothing, component_id is
    the own id. Rows with a null id link as copies of rows with the same set do; a set
    that only they have links with nothing (component_id null). Repeated rows are repeated in the
    result. Other columns are ignored, whatever their names. Empty input:
    empty result.
    """
    t_num, t_den = threshold
    spark = docs.sparkSession
    bound = min(2**64 - 1, int(min(1.0, 2.5 * (1 - t_num / t_den)) * 2**64))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = stage_table(source.mapInArrow(_profile(words, t_num, t_den), f"id {kind}, n_shingles long, fp long, low binary"), "profile")
    if buckets is None:  # a bucket holds about two million hashes
        held = rows.agg(F.sum(F.length("low"))).first()[0] or 0
        buckets = max(12, math.ceil(held / 8 / 2e6))
    some = rows.where("fp is not null")
    cells, hubs = _common(some.select("low"), buckets, bound, common_least, hub_list, common_cells)
    order = spark.sparkContext.broadcast(_Order(cells, bound))
    hubs = spark.sparkContext.broadcast(hubs)
    low = some.select("fp", "n_shingles", "low")
    grouped = stage_table(low.mapInArrow(_prefixed(order, t_num, t_den), "fp long, n long, grp long, prefix binary"), "prefixes")
    slim = stage_table(rows.select("id", "n_shingles", "fp"), "rows")
    drop_table(rows)
    free_shuffles(spark)
    rows = slim
    some = rows.where("fp is not null")
    groups = grouped.select("fp", "grp").distinct()
    entries = grouped.select("n", "grp", "prefix")
    pairs = entries.mapInArrow(_postings(hubs, buckets), "bucket int, e binary")
    pairs = pairs.groupBy("bucket").applyInPandas(_candidates(t_num, t_den, long_list), "u long, v long, w long, asked long")
    pairs = pairs.groupBy("u", "v").agg(F.sum("w").alias("w"), F.max("asked").alias("asked")).where("w >= asked").select("u", "v")
    near = components(pairs.union(entries.mapInArrow(_hubs(hubs, t_num, t_den), "u long, v long")), in_one_task)

    # Expand groups into classes; a group of several classes is itself a candidate.
    classes = some.groupBy("fp").agg(F.min("id").alias("first"), F.max("n_shingles").alias("n"), F.count("*").alias("size"))
    several = groups.groupBy("grp").count().where("count > 1").select("grp")
    cands = near.select(F.col("node").alias("grp"), "root").join(several, "grp", "full").select("grp", F.coalesce("root", "grp").alias("root"))
    cands = stage_table(groups.join(cands, "grp").join(classes, "fp").where("first is not null").select("fp", "root", "first", "n"), "cands")
    drop_table(grouped)
    free_shuffles(spark)
    totals = cands.groupBy("root").agg(F.sum("n").alias("total"))
    tasks = _tasks(cands, totals, task_shingles, t_num, t_den)
    texts = source.join(tasks.select(F.col("first").alias("id"), "fp", "tasks"), "id").select("fp", "tasks", "text")
    work = texts.mapInArrow(_hashes(words), "fp long, tasks array<string>, hashes binary")
    work = work.select("fp", F.explode("tasks").alias("task"), "hashes")
    links = work.groupBy("task").applyInPandas(_verified(words, t_num, t_den), "u long, v long")
    linked = components(links, in_one_task)

    label = linked.withColumnRenamed("node", "fp").join(classes.select("fp", "first"), "fp")
    least = label.groupBy("root").agg(F.min("first").alias("least"))
    label = label.join(least, "root").select("fp", "least")
    label = classes.select("fp", "first", "size").join(label, "fp", "left").select("fp", "size", F.coalesce("least", "first").alias("least"))
    label = stage_table(label, "labels")
    drop_table(cands)
    free_shuffles(spark)
    # Rows of the large classes (a bounded number of them) and rows without a
    # set, which have no class, are dealt out evenly.
    floor = max(1000, math.ceil(rows.count() * 1e-4))
    large = label.where(F.col("size") >= floor).select("fp", F.col("least").alias("of_large"), F.lit(True).alias("is_large"))
    out = rows.select("id", "n_shingles", "fp").join(F.broadcast(large), "fp", "left")
    key = F.when(F.col("fp").isNotNull() & F.col("is_large").isNull(), F.struct("fp", F.lit(None).cast("long").alias("spread")))
    out = out.withColumn("key", F.coalesce(key, F.struct(F.lit(0).cast("long").alias("fp"), F.xxhash64("id").alias("spread"))))
    others = label.where(F.col("size") < floor).select(F.struct("fp", F.lit(None).cast("long").alias("spread")).alias("key"), "least")
    out = out.join(others.withColumnRenamed("key", "key2"), F.col("key").eqNullSafe(F.col("key2")), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("of_large", "least", "id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all columns, less near copies: of each component the
    document with the smallest id stays. Rows that repeat an id and a text are
    copies too. Texts without words and rows without an id stay. Other columns
    may have any names; of repeated rows that differ there, any one stays.
    Empty input: no rows.
    """
    links = jaccard_join(docs, words, threshold, id_col, text_col, **options).toDF(id_col, "n_shingles", "component_id")
    other = free_name(docs, "gone")
    gone = links.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(other)).distinct()
    with_id = docs.where(F.col(id_col).isNotNull())
    kept = with_id.join(gone, F.col(id_col) == F.col(other), "left_anti")
    mark = free_name(docs, "text_hash")
    kept = kept.withColumn(mark, F.xxhash64(text_col)).dropDuplicates([id_col, mark]).select(*docs.columns)
    return kept.union(docs.where(F.col(id_col).isNull()))


def _tasks(cands: DataFrame, totals: DataFrame, task_shingles: int, t_num: int, t_den: int) -> DataFrame:
    """(fp, first, tasks): the tasks that each class takes part in. A
    component of up to ``task_shingles`` is one task. A larger one is cut into
    blocks by size of set and within it by hash; each pair of blocks whose
    sizes may match is a task."""
    x = cands.join(totals, "root")
    # Sizes fall into steps by the threshold; only a step and its neighbour can match.
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(t_den / t_num))).alias("step")
    x = x.withColumn("step", F.when(F.col("total") <= task_shingles, F.lit(0)).otherwise(step))
    held = x.groupBy("root", "step").agg(F.sum("n").alias("held"))
    held = held.withColumn("blocks", F.ceil(F.col("held") * 2 / F.lit(task_shingles)).cast("int"))
    beside = held.select("root", (F.col("step") - 1).alias("step"), F.col("blocks").alias("above"))
    below = held.select("root", (F.col("step") + 1).alias("step"), F.col("blocks").alias("below"))
    x = x.join(held, ["root", "step"]).join(beside, ["root", "step"], "left").join(below, ["root", "step"], "left")
    b = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    x = x.withColumn("b", b).withColumn("big", F.col("total") > task_shingles)
    name = lambda *parts: F.concat_ws(":", "root", *parts)
    same = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: name(F.col("step"), F.least(o, F.col("b")), F.greatest(o, F.col("b"))))
    up = F.when(F.col("above").isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda o: name(F.col("step"), F.col("b"), F.lit("up"), o)))
    down = F.when(F.col("below").isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda o: name(F.col("step") - 1, o, F.lit("up"), F.col("b"))))
    tasks = F.when(F.col("big"), F.concat(same, up, down)).otherwise(F.array(F.col("root").cast("string")))
    return x.select("fp", "first", tasks.alias("tasks"))
