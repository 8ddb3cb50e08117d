"""Language-model scores by a hierarchical Pitman-Yor model.

Restaurants. Every word that training texts hold, and the start of a text, is
a context and has a restaurant over the words that follow it (a word or the
end); all restaurants have one parent, a restaurant over all types and one
unknown - the sample space is that of the baseline. Seatings are sampled by
Gibbs (``seating``): given the parent, every restaurant draws the tables of one
dish after another; tables are the parent's customers, which draws its tables
in turn; then strengths and discounts are drawn. The predictive probabilities
of several samples are averaged. Contexts and words are all there are.

Where things are. Pairs of words are dealt to buckets by their context, pairs
of contexts with many tokens by the pair, so no restaurant is one task's
unless it is small; the tables of those contexts are added up between rounds
and broadcast. The parent is dealt by word. Probabilities of frequent words are
broadcast, those of others are asked for by bucket. Words and contexts that are
broadcast have a share of the tokens, so they are bounded in number.

Disk. Texts are cheap to read and pairs are not cheap to keep: pairs are
counted in ``slices`` of the buckets, one after the other, and again when texts
are scored, where every bucket seats its restaurants anew under each sampled
parent. What stays are cells of two customers or more.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seating
from .common import U64, drop_table, free_shuffles, mix, remainder, stage_table, text_chunks, words_of

#: The end of a text and the context of its first token, as hashes.
END, START = U64(0x7F4A7C159E3779B9), U64(0x1CE4E5B9BF58476D)
#: Contexts with this share of the tokens (or of ``bucket_tokens`` / 4 tokens,
#: if that is less) are dealt out by pairs; the probabilities of pairs with as
#: many tokens are broadcast.
HOT = 1e-4
_GROUP_ROWS, _GROUP_BYTES = 4096, 8 << 20
_LANES = 64
_LOW = U64((1 << 24) - 1)
_TAIL = np.dtype([("h", "<u8"), ("r", "<u4")])
_PART = np.dtype([("r", "<u4"), ("known", "<u4"), ("base", "<f8"), ("model", "<f8")])
_SUM = np.dtype([("r", "<u4"), ("model", "<f8")])
# Rows of several kinds in one table: what they are about, packed arrays.
CELLS, DISHES, ASKS, SPREAD, SUMS, PAIRS = range(6)
_PACKED = "kind int, key int, other int, a binary, b binary, c binary, d binary, e binary"


def _by_bucket(h: np.ndarray, buckets: int):
    """(bucket, positions) for each bucket that has hashes."""
    if not len(h):
        return []
    which = (h % U64(buckets)).astype(np.int64)
    o = np.argsort(which, kind="stable")
    some, first = np.unique(which[o], return_index=True)
    return list(zip(some.tolist(), np.split(o, first[1:]), strict=True))


def _numbered(batches):
    """(id, text, held_out) -> the same with group and row number in it; a
    group is of bounded size."""
    n = TaskContext.get().partitionId() << 32
    for b in batches:
        size = b.column(1).cast(pa.large_string()).fill_null("")
        size = np.cumsum(np.diff(np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1])) if len(size) else np.zeros(0, np.int64)
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(size, (size[i - 1] if i else 0) + _GROUP_BYTES, side="right"))
            j = min(max(j, i + 1), i + _GROUP_ROWS)
            part = b.slice(i, j - i)
            n += 1
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(j - i, n)), pa.array(np.arange(j - i, dtype=np.int32))], ["id", "text", "held_out", "grp", "r"])
            i = j


def _groups(b: pa.RecordBatch):
    """The runs of one group in a batch of (id, text, held_out, grp, r)."""
    g = b.column(3).to_numpy()
    cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else []
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield int(g[i]), b.slice(i, j - i)


def _batch_counts(batches):
    """Training texts -> packed (hash, count) of a batch, and its texts."""
    for b in batches:
        parts = [words_of(data, offs)[0] for _, _, data, offs in text_chunks(b.column(0))]
        h, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([h.tobytes()], pa.binary()), pa.array([c.astype(np.uint32).tobytes()], pa.binary()), pa.array([len(h)], pa.int64()), pa.array([b.num_rows], pa.int64())],
            ["h", "c", "distinct", "texts"],
        )


def _split(buckets: int):
    def run(batches):
        for b in batches:
            for hs, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, c = np.frombuffer(hs, np.uint64), np.frombuffer(cs, np.uint32)
                rows = _by_bucket(h, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int32()), pa.array([h[i].tobytes() for _, i in rows], pa.binary()), pa.array([c[i].tobytes() for _, i in rows], pa.binary())],
                    ["bucket", "h", "c"],
                )

    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    h = np.frombuffer(b"".join(pdf["h"]), np.uint64)
    c = np.frombuffer(b"".join(pdf["c"]), np.uint32)
    o = np.argsort(h, kind="stable")
    h, c = h[o], c[o].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    h, c = h[first], np.add.reduceat(c, first)
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "h": [h.tobytes()], "c": [c.tobytes()], "tokens": [c.sum()], "types": [len(c)]})


def _above(floor: int):
    def run(frames):
        for f in frames:
            for hs, cs in zip(f["h"], f["c"], strict=True):
                h, c = np.frombuffer(hs, np.uint64), np.frombuffer(cs, np.int64)
                yield pd.DataFrame({"h": [h[c >= floor].tobytes()], "c": [c[c >= floor].tobytes()]})

    return run


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * U64(0x2545F4914F6CDD1D) + w)


def pairs_of(h: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) of every token: the words first, then each text's end."""
    u = np.full(len(h), START, np.uint64)
    end = np.full(texts, START, np.uint64)
    if len(h):
        u[1:] = np.where(doc[1:] == doc[:-1], h[:-1], START)
        last = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True])))
        end[doc[last]] = h[last]
    return np.concatenate((u, end)), np.concatenate((h, np.full(texts, END)))


def _found(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes are in a sorted table, and whether they are."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def _found_often(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_found`` where most hashes occur again and again."""
    o = np.argsort(h)
    first = np.concatenate(([True], h[o][1:] != h[o][:-1])) if len(h) else np.zeros(0, bool)
    at, some = _found(table, h[o[first]])
    number = np.empty(len(h), np.int64)
    number[o] = np.cumsum(first) - 1
    return at[number], some[number]


class Shape:
    """How words, contexts and pairs are dealt out, and what is broadcast."""

    def __init__(self, head_h, head_c, tokens, types, ends, buckets, word_buckets, slices, hot_floor):
        self.head_h, self.head_c = head_h, head_c
        self.tokens, self.types, self.ends = tokens, types, ends
        self.buckets, self.word_buckets, self.slices = buckets, word_buckets, slices
        self.kinds = 1 + types  # and one unknown
        self.hot_floor = hot_floor
        hot = (head_c >= hot_floor) & (head_h != END)
        h, n = np.append(head_h[hot], START), np.append(head_c[hot], ends)
        o = np.argsort(h)
        self.hot_h, self.hot_n = h[o], n[o]
        self.head_log = np.log10(head_c + 0.5)
        self.base_norm = math.log10(tokens + 0.5 * (types + 1))

    def place(self, u, w, mixed, k: int):
        """The bucket of each pair of slice k (``mixed`` mod ``slices`` is k)."""
        each = U64(self.buckets // self.slices)
        own = np.where(_found_often(self.hot_h, u)[1], pair_hash(u, w), mixed // U64(self.slices))
        return (own % each).astype(np.int64) * self.slices + k


def _tokens_of(part: pa.RecordBatch, shape: Shape, k: int, only_learnt: bool):
    """(context, word, bucket, row, learnt) of a group's tokens in slice k,
    ordered by bucket and context, equal pairs together (but for one in 2**64)."""
    held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
    rows = part.column(4).to_numpy()
    got = []
    for i, j, data, offs in text_chunks(part.column(1)):
        h, doc, _ = words_of(data, offs)
        u, w = pairs_of(h, doc, j - i)
        mixed = mix(u)
        keep = np.flatnonzero(mixed % U64(shape.slices) == k)
        owner = np.concatenate((doc, np.arange(j - i)))[keep] + i
        if only_learnt:
            keep, owner = keep[~held[owner]], owner[~held[owner]]
        u, w, mixed = u[keep], w[keep], mixed[keep]
        got.append((u, w, mixed, rows[owner], ~held[owner]))
    if not got:
        return None
    u, w, mixed, rows, learnt = (np.concatenate(x) for x in zip(*got, strict=True))
    o = np.argsort(mixed & ~_LOW | mix(w) & _LOW)
    u, w = u[o], w[o]
    place = shape.place(u, w, mixed[o], k)
    again = np.argsort(place.astype(np.uint16 if shape.buckets < 1 << 16 else np.uint32), kind="stable")
    o = o[again]
    return u[again], w[again], place[again], rows[o], learnt[o]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (kind, key, other, arrays...) as ``_PACKED`` has them."""
    data = [[None if len(r) <= 3 + c else r[3 + c].tobytes() for r in rows] for c in range(5)]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32()) for c in range(3)] + [pa.array(x, pa.binary()) for x in data], ["kind", "key", "other", "a", "b", "c", "d", "e"])


def _packed_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = _packed(rows).to_pandas()
    return frame.astype({"kind": "int32", "key": "int32", "other": "int32"})


def _pair_counts(sent, k: int):
    """Training texts -> distinct pairs of each group and bucket (a: contexts,
    b: words, c: how often)."""

    def run(batches):
        shape = sent.value
        for b in batches:
            for _, part in _groups(b):
                if (got := _tokens_of(part, shape, k, True)) is None or not len(got[0]):
                    continue
                u, w, place = got[:3]
                first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))
                n = np.diff(np.append(first, len(u))).astype(np.uint32)
                u, w, place = u[first], w[first], place[first]
                cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))).tolist()
                yield _packed([(CELLS, int(place[i]), 0, u[i:j], w[i:j], n[i:j]) for i, j in zip(cuts, [*cuts[1:], len(u)], strict=True)])

    return run


def _summed_pairs(u, w, n):
    """Distinct pairs, ordered by context, their sums, and the number of each
    row's pair. Pairs are told apart by their hash."""
    h = pair_hash(u, w)
    o = np.argsort(h)
    h = h[o]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    del h
    n = np.add.reduceat(n[o].astype(np.int64), first)
    size = np.diff(np.append(first, len(o)))
    first = o[first]
    by_context = np.argsort(u[first])
    number = np.empty(len(first), np.int64)
    number[by_context] = np.arange(len(first))
    back = np.empty(len(o), np.int64)
    back[o] = np.repeat(number, size)
    first = first[by_context]
    return u[first], w[first], n[by_context], back


def _contexts(shape: Shape, u, n):
    """Of a bucket's pairs (ordered by context): the number of each one's
    restaurant - those dealt out by pairs behind the others - and customers,
    singles and hashes of the others."""
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), u
    start = np.concatenate(([True], u[1:] != u[:-1]))
    contexts = u[start]
    at, hot = _found(shape.hot_h, contexts)
    m = int((~hot).sum())
    number = np.where(hot, m + at, np.cumsum(~hot) - 1)[np.cumsum(start) - 1]
    cold = number < m
    customers = np.bincount(number[cold], n[cold], minlength=m).astype(np.int64)
    ones = np.bincount(number[cold], n[cold] == 1, minlength=m).astype(np.int64)
    return number, customers, ones, contexts[~hot]


def _cells(sent):
    """A bucket's pairs -> its cells of two customers or more with their
    restaurants, contexts by word, and the words whose probability it needs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = sent.value
        key = int(pdf["key"].iloc[0])
        u, w, n, _ = _summed_pairs(*(np.frombuffer(b"".join(pdf[c]), t) for c, t in (("a", np.uint64), ("b", np.uint64), ("c", np.uint32))))
        r, customers, ones, _ = _contexts(shape, u, n)
        many = n > 1
        rows = [(CELLS, key, 0, customers, ones, r[many], w[many], n[many])]
        dish, count = np.unique(w, return_counts=True)
        rows += [(DISHES, x, 0, dish[i], count[i]) for x, i in _by_bucket(dish, shape.word_buckets)]
        ask = np.unique(w[many])
        ask = ask[~_found(shape.head_h, ask)[1]]
        rows += [(ASKS, x, key, ask[i]) for x, i in _by_bucket(ask, shape.word_buckets)]
        rows += _spread(r[r >= len(customers)] - len(customers), np.ones((r >= len(customers)).sum()), len(shape.hot_h))
        return _packed_frame(rows)

    return run


def _spread(number, tables, size: int) -> list[tuple]:
    """Tables of contexts that are dealt out by pairs, in lanes."""
    total = np.bincount(number, tables, minlength=size).astype(np.int64)
    some = np.flatnonzero(total)
    return [(SPREAD, int(x), 0, some[i], total[some[i]]) for x, i in _by_bucket(some.astype(np.uint64), _LANES)]


def _first_parent(pdf: pd.DataFrame) -> pd.DataFrame:
    w = np.frombuffer(b"".join(pdf["a"]), np.uint64)
    n = np.frombuffer(b"".join(pdf["b"]), np.int64)
    w, back = np.unique(w, return_inverse=True)
    c = np.bincount(back, n, minlength=len(w)).astype(np.int64)
    return _parent_row(int(pdf["key"].iloc[0]), w, c, c, np.ones(len(w), np.int64), np.zeros((len(w), 0)))


_PARENT = "key int, w binary, k binary, c binary, t binary, bases binary, customers long, tables long, sums binary"


def _parent_row(key, w, k, c, t, bases) -> pd.DataFrame:
    s = seating.sums(c, t, [], [])
    packed = {"w": w, "k": k, "c": c, "t": t, "bases": bases.astype(np.float32), "sums": s}
    return pd.DataFrame({"key": np.array([key], np.int32)} | {x: [v.tobytes()] for x, v in packed.items()} | {"customers": [int(c.sum())], "tables": [int(t.sum())]})[[x.split()[0] for x in _PARENT.split(", ")]]


def _unpacked(row):
    w, k, c, t = (np.frombuffer(row[x], y) for x, y in (("w", np.uint64), ("k", np.int64), ("c", np.int64), ("t", np.int64)))
    bases = np.frombuffer(row["bases"], np.float32)
    return w, k, c, t, bases.reshape(len(w), len(bases) // max(len(w), 1))


class Parent:
    """The parent's totals and parameters, from which a word's probability
    follows from its customers and tables."""

    def __init__(self, customers: int, tables: int, kinds: int, theta: float, d: float):
        self.customers, self.tables, self.kinds, self.theta, self.d = customers, tables, kinds, theta, d

    @property
    def unknown(self) -> float:
        return (self.theta + self.d * self.tables) / self.kinds / (self.theta + self.customers)

    def base(self, c, t):
        return np.maximum(c - self.d * t, 0) / (self.theta + self.customers) + self.unknown


def _answers(parent: Parent | None):
    """A word bucket's parent row and the words that buckets ask about -> (key:
    the asking bucket, a: words, b: probabilities): of ``parent``'s state, or
    without one the samples kept."""

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            w, _, c, t, bases = _unpacked(rows.iloc[0])
            if parent is not None:
                bases = parent.base(c, t)[:, None].astype(np.float32)
            for other, part in asks.groupby("other"):
                ask = np.unique(np.frombuffer(b"".join(part["a"]), np.uint64))
                at, some = _found(w, ask)
                if some.any():
                    out.append((ASKS, int(other), 0, ask[some], bases[at[some]]))
        return _packed_frame(out)

    return run


def _bases(shape: Shape, head, answers: pd.DataFrame, unknown, w) -> np.ndarray:
    """Probabilities of words under the parent, words x samples: frequent words
    from ``head``, others as answered, else ``unknown``."""
    out = np.tile(np.asarray(unknown, np.float32), (len(w), 1))
    at, some = _found_often(shape.head_h, w)
    out[some] = head[at[some]]
    if len(answers):
        h = np.frombuffer(b"".join(answers["a"]), np.uint64)
        p = np.frombuffer(b"".join(answers["b"]), np.float32).reshape(len(h), out.shape[1])
        o = np.argsort(h)
        at, known = _found(h[o], w)
        known &= ~some
        out[known] = p[o][at[known]]
    return out


class Round:
    """What a round of seating needs of the state before it."""

    def __init__(self, parent, head, hot_tables, theta, d, number, inner, seed):
        self.parent, self.head, self.hot_tables = parent, head, hot_tables
        self.theta, self.d, self.number = theta, d, number
        self.inner, self.seed = inner, seed


def _seated(sent, state, kept: bool):
    """A bucket's cells and the answers to it -> tables beyond the first by
    word, tables of contexts dealt out by pairs, what seatings tell of the
    parameters, and (if ``kept``) probabilities of common pairs."""

    def run(cells: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return _packed_frame([])
        shape, now = sent.value, state.value
        key = int(cells["key"].iloc[0])
        rng = np.random.default_rng((now.seed, now.number, key))
        row = cells.iloc[0]
        customers, ones, r, n = (np.frombuffer(row[c], np.int64) for c in "abce")
        w = np.frombuffer(row["d"], np.uint64)
        base = _bases(shape, now.head[:, None], answers, [now.parent.unknown], w)[:, 0]
        m = len(customers)
        own = r < m
        tables = np.concatenate((ones + np.bincount(r[own], minlength=m), now.hot_tables))
        t = seating.sweeps(r, n, tables, base, now.theta, now.d, rng, now.inner, fixed=m)
        dish, back = np.unique(w[t > 1], return_inverse=True)
        more = np.bincount(back, t[t > 1] - 1, minlength=len(dish)).astype(np.int64)
        rows = [(DISHES, x, 0, dish[i], more[i]) for x, i in _by_bucket(dish, shape.word_buckets)]
        rows += _spread(r[~own] - m, t[~own] - 1, len(shape.hot_h))
        rows.append((SUMS, key % 16, 0, seating.sums(n, t, tables[:m], customers)))
        if kept and (often := np.flatnonzero(n >= shape.hot_floor)).size:
            size = np.concatenate((customers, shape.hot_n))[r[often]]
            p = (n[often] - now.d * t[often] + (now.theta + now.d * tables[r[often]]) * base[often]) / (now.theta + size)
            # Their contexts are no less frequent, so they are dealt out by pairs.
            rows.append((PAIRS, key, 0, pair_hash(shape.hot_h[r[often] - m], w[often]), p))
        return _packed_frame(rows)

    return run


def _parent_seated(before: Parent, number: int, kept: bool, seed: int):
    """A word bucket's parent row and the tables beyond the first that its words
    have in restaurants -> the parent's row after drawing its own tables; what
    it was before is added to the samples if ``kept``."""

    def run(rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        w, k, c, t, bases = _unpacked(rows.iloc[0])
        if kept:
            bases = np.column_stack((bases, before.base(c, t)))
        h = np.frombuffer(b"".join(more["a"]), np.uint64)
        n = np.frombuffer(b"".join(more["b"]), np.int64)
        c = k + np.bincount(np.searchsorted(w, h), n, minlength=len(w)).astype(np.int64)
        rng = np.random.default_rng((seed, number, int(rows["key"].iloc[0]), 1))
        rest = before.tables - t
        base = np.full(len(w), 1 / before.kinds)
        big = c > seating.EXACT
        t = np.empty(len(w), np.int64)
        for part, law in ((~big, seating.draw), (big, seating.crowd)):
            t[part] = law(c[part], rest[part], base[part], before.theta, before.d, rng)
        return _parent_row(int(rows["key"].iloc[0]), w, k, c, t, bases)

    return run


def _head_of(sent, parent: Parent | None):
    """Parent rows -> the frequent words (a: places in the head, b: probabilities)."""

    def run(frames):
        shape = sent.value
        for f in frames:
            for _, row in f.iterrows():
                w, _, c, t, bases = _unpacked(row)
                at, some = _found(shape.head_h, w)
                p = parent.base(c, t) if parent else bases
                yield _packed_frame([(DISHES, 0, 0, at[some], p[some].astype(np.float32))])

    return run


def _head(parents: DataFrame, sent, shape: Shape, unknown, parent: Parent | None = None) -> np.ndarray:
    """Words of the head x samples (or the one state of ``parent``)."""
    out = np.tile(np.asarray(unknown, float), (len(shape.head_h), 1))
    for r in parents.mapInPandas(_head_of(sent, parent), _PACKED).select("a", "b").collect():  # the head is bounded
        at = np.frombuffer(r.a, np.int64)
        out[at] = np.frombuffer(r.b, np.float32).reshape(len(at), out.shape[1])
    return out


def _added_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one kind and key, as one: a: numbers, b: their sums (``SPREAD``),
    or a: sums (``SUMS``)."""
    kind, key = int(pdf["kind"].iloc[0]), int(pdf["key"].iloc[0])
    if kind == SUMS:
        return _packed_frame([(SUMS, key, 0, np.sum([np.frombuffer(x) for x in pdf["a"]], axis=0))])
    at, back = np.unique(np.frombuffer(b"".join(pdf["a"]), np.int64), return_inverse=True)
    n = np.frombuffer(b"".join(pdf["b"]), np.int64)
    return _packed_frame([(SPREAD, key, 0, at, np.bincount(back, n, minlength=len(at)).astype(np.int64))])


def _totals(table: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of the contexts dealt out by pairs, and the sums for the
    parameters: at most ``_LANES`` + 16 rows reach the driver."""
    spread, sums = np.zeros(size, np.int64), np.zeros(seating.N_SUMS)
    few = table.where(F.col("kind").isin(SPREAD, SUMS)).groupBy("kind", "key").applyInPandas(_added_up, _PACKED)
    for r in few.select("kind", "a", "b").collect():
        if r.kind == SUMS:
            sums += np.frombuffer(r.a)
        else:
            spread[np.frombuffer(r.a, np.int64)] += np.frombuffer(r.b, np.int64)
    return spread, sums


class Scoring:
    """The kept samples, to score tokens by."""

    def __init__(self, samples, head, unknown, common_h, common_p, inner, seed):
        self.samples = samples  # (theta, d, tables of contexts dealt out by pairs)
        self.head, self.unknown = head.astype(np.float32), unknown  # words x samples, samples
        self.common_h, self.common_p = common_h, common_p
        self.inner, self.seed = inner, seed


def sampled(numbered: DataFrame, shape: Shape, sent, burn_in: int, samples: int, inner: int, seed: int, parameters: tuple[float, float, float, float] | None):
    """Run the rounds over the training texts -> (the parent's rows, staged,
    with the samples of every word's probability; ``Scoring``).
    ``parameters`` (strength, discount, the parent's two) are drawn if None."""
    spark = numbered.sparkSession
    cells = []
    for k in range(shape.slices):
        pairs = numbered.where("not held_out").mapInArrow(_pair_counts(sent, k), _PACKED)
        cells.append(stage_table(pairs.groupBy("key").applyInPandas(_cells(sent), _PACKED), "cells"))
        free_shuffles(spark)
    tables = cells[0]
    for x in cells[1:]:
        tables = tables.unionByName(x)
    parents = tables.where(F.col("kind") == DISHES).groupBy("key").applyInPandas(_first_parent, _PARENT)
    parents = stage_table(parents, "parent")
    distinct, _ = _totals(tables, len(shape.hot_h))
    hot_tables = distinct
    rng = np.random.default_rng(seed)
    theta, d, theta0, d0 = parameters or (1.0, 0.75, 1.0, 0.5)
    kept_rounds, common = [], {}
    unknown = []
    for number in range(burn_in + samples):
        kept = number >= burn_in
        size = parents.agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).first()
        parent = Parent(int(size.customers or 0), int(size.tables or 0), shape.kinds, theta0, d0)
        head = _head(parents, sent, shape, [parent.unknown], parent=parent)[:, 0]
        state = spark.sparkContext.broadcast(Round(parent, head, hot_tables, theta, d, number, inner, seed))
        asks = tables.where(F.col("kind") == ASKS)
        answers = parents.groupBy("key").cogroup(asks.groupBy("key")).applyInPandas(_answers(parent), _PACKED)
        mine = tables.where(F.col("kind") == CELLS)
        seated = stage_table(mine.groupBy("key").cogroup(answers.groupBy("key")).applyInPandas(_seated(sent, state, kept), _PACKED), "seated")
        more, sums = _totals(seated, len(shape.hot_h))
        hot_tables = distinct + more
        rows = parents.groupBy("key").cogroup(seated.where(F.col("kind") == DISHES).groupBy("key"))
        after = stage_table(rows.applyInPandas(_parent_seated(parent, number, kept, seed), _PARENT), "parent")
        drop_table(parents)
        parents = after
        if kept:
            kept_rounds.append((theta, d, hot_tables))
            unknown.append(parent.unknown)
            for r in seated.where(F.col("kind") == PAIRS).select("a", "b").toLocalIterator():  # at most 1 / HOT pairs
                for h, p in zip(np.frombuffer(r.a, np.uint64).tolist(), np.frombuffer(r.b).tolist(), strict=True):
                    common[h] = common.get(h, 0.0) + p / samples
        if parameters is None:
            theta, d = seating.sample_parameters(sums + seating.sums([], [], hot_tables, shape.hot_n), rng)
            s = np.zeros(seating.N_SUMS)
            for r in parents.groupBy(F.col("key") % 16).applyInPandas(lambda f: pd.DataFrame({"sums": [np.sum([np.frombuffer(x) for x in f["sums"]], axis=0).tobytes()]}), "sums binary").collect():
                s += np.frombuffer(r["sums"])
            size = parents.agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).first()
            theta0, d0 = seating.sample_parameters(s + seating.sums([], [], [size.tables or 0], [size.customers or 0]), rng)
        drop_table(seated)
        state.unpersist()
        free_shuffles(spark)
    for x in cells:
        drop_table(x)
    head = _head(parents, sent, shape, unknown)
    h = np.array(sorted(common), np.uint64)
    p = np.log10([common[x] for x in h.tolist()])
    return parents, Scoring(kept_rounds, head, np.array(unknown), h, p, inner, seed)


# --- scores --------------------------------------------------------------


_TOKENS = "key int, grp long, u binary, w binary, learnt binary, size binary, rows binary"


def _listed(sent, scoring, k: int):
    """Texts -> by bucket each group's distinct pairs, how often they are
    learnt from, and the rows of their tokens (none for common pairs)."""

    def run(batches):
        shape, common = sent.value, scoring.value.common_h
        for b in batches:
            for group, part in _groups(b):
                if (got := _tokens_of(part, shape, k, False)) is None or not len(got[0]):
                    continue
                u, w, place, rows, learnt = got
                first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))
                n = np.add.reduceat(learnt.astype(np.int64), first).astype(np.uint32)
                size = np.diff(np.append(first, len(u)))
                u, w, place = u[first], w[first], place[first]
                often = _found(common, pair_hash(u, w))[1]
                rows = rows[~np.repeat(often, size)].astype(np.uint16)
                size = np.where(often, 0, size)
                ends = np.concatenate(([0], np.cumsum(size)))
                size = size.astype(np.uint32)
                cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))).tolist()
                out = [(int(place[i]), group, u[i:j].tobytes(), w[i:j].tobytes(), n[i:j].tobytes(), size[i:j].tobytes(), rows[ends[i] : ends[j]].tobytes()) for i, j in zip(cuts, [*cuts[1:], len(u)], strict=True)]
                kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _TOKENS.split(", ")])

    return run


def _pair_logs(shape: Shape, scoring: Scoring, u, w, n, bases, key: int) -> np.ndarray:
    """log10 P(w | u) of distinct pairs that are all of a bucket, ordered by
    context: restaurants are seated under each sample, probabilities averaged."""
    seen = n > 0
    r, customers, ones, contexts = _contexts(shape, u[seen], n[seen])
    m, hot = len(customers), len(shape.hot_h)
    many = n[seen] > 1
    # Restaurants of all pairs; the last one is empty, for unknown contexts.
    at, cold = _found(contexts, u)
    spread, is_hot = _found(shape.hot_h, u)
    number = np.where(is_hot, m + spread, np.where(cold, at, m + hot))
    size = np.concatenate((customers, shape.hot_n, [0]))
    own = r[many] < m
    total, now = 0.0, None
    t = seen.astype(np.int64)
    where = np.flatnonzero(seen)[many]
    for s, (theta, d, hot_tables) in enumerate(scoring.samples):
        rng = np.random.default_rng((scoring.seed, s, key, 2))
        own_tables = np.bincount(r[many][own], now[own] if s else None, minlength=m).astype(np.int64)
        tables = np.concatenate((ones + own_tables, hot_tables, [0]))
        # The chain goes on from sample to sample.
        now = seating.sweeps(r[many], n[where], tables, bases[where, s], theta, d, rng, 1 if s else scoring.inner, fixed=m, before=now)
        t[where] = now
        total = total + (n - d * t + (theta + d * tables[number]) * bases[:, s]) / (theta + size[number])
    return np.log10(total / len(scoring.samples))


def _token_scores(sent, kept):
    """A bucket's tokens and the answers to it -> sums of log10 P by group and row."""

    def run(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(tokens):
            return pd.DataFrame({"grp": pd.Series([], dtype="int64"), "data": []})
        shape, scoring = sent.value, kept.value
        u, w, n = (np.frombuffer(b"".join(tokens[c]), t) for c, t in (("u", np.uint64), ("w", np.uint64), ("learnt", np.uint32)))
        u, w, n, back = _summed_pairs(u, w, n)
        tokens = tokens[["key", "grp", "size", "rows"]]
        bases = _bases(shape, scoring.head, answers, scoring.unknown, w)
        logs = _pair_logs(shape, scoring, u, w, n, bases, int(tokens["key"].iloc[0]))[back]
        del u, w, n, bases, back
        groups, data, i = [], [], 0
        for group, size, rows in zip(tokens["grp"], tokens["size"], tokens["rows"], strict=True):
            size = np.frombuffer(size, np.uint32)
            p = np.repeat(logs[i : i + len(size)], size)
            i += len(size)
            r, at = np.unique(np.frombuffer(rows, np.uint16), return_inverse=True)
            out = np.empty(len(r), _SUM)
            out["r"], out["model"] = r, np.bincount(at, p, minlength=len(r))
            groups.append(group)
            data.append(out.tobytes())
        return pd.DataFrame({"grp": pd.Series(groups, dtype="int64"), "data": data})

    return run


def _summed_up(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.frombuffer(b"".join(pdf["data"]), _SUM)
    r, back = np.unique(x["r"], return_inverse=True)
    out = np.zeros(len(r), _PART)
    out["r"], out["model"] = r, np.bincount(back, x["model"], minlength=len(r))
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "data": [out.tobytes()]})


_ROW = ["bucket", "grp", "data", "id", "held_out", "r", "n_tokens", "n_known", "base_score", "score"]


def _counted(sent, scoring):
    """Texts -> their rows, with what broadcast words and pairs add; by word
    bucket the other words; and by word bucket (numbered behind those) the
    other words that a bucket of pairs (grp) will ask about."""

    def run(batches):
        shape, common = sent.value, scoring.value
        maybe = np.zeros(1 << 16, bool)
        maybe[(common.common_h & U64(0xFFFF)).astype(np.int64)] = True
        for b in batches:
            for group, part in _groups(b):
                rows, tails, asks = [], [], []
                at_row = part.column(4).to_numpy()
                for i, j, data, offs in text_chunks(part.column(1)):
                    h, doc, _ = words_of(data, offs)
                    n = j - i
                    u, w = pairs_of(h, doc, n)
                    p = pair_hash(u, w)
                    often = np.flatnonzero(maybe[(p & U64(0xFFFF)).astype(np.int64)])
                    at, some = _found(common.common_h, p[often])
                    at, often = at[some], often[some]
                    owner = np.concatenate((doc, np.arange(n)))
                    score = np.bincount(owner[often], common.common_p[at], minlength=n)
                    base = np.full(n, math.log10(shape.ends + 0.5))
                    known = np.full(n, int(shape.ends > 0))
                    at, head = _found_often(shape.head_h, h)
                    base += np.bincount(doc[head], shape.head_log[at[head]], minlength=n)
                    known += np.bincount(doc[head], minlength=n)
                    count = np.bincount(doc, minlength=n) + 1
                    rows.append((count, known, base - count * shape.base_norm, score))
                    rare = np.flatnonzero(~head)
                    asks.append(np.stack((h[rare], _places(shape, u[rare], h[rare]))))
                    tail = np.empty(len(rare), _TAIL)
                    tail["h"], tail["r"] = h[rare], at_row[i + doc[rare]]
                    tails.append(tail)
                count, known, base, score = (np.concatenate(x) for x in zip(*rows, strict=True))
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int32()), pa.array(np.full(n, group)), pa.nulls(n, pa.binary()), part.column(0), part.column(2), pa.array(at_row.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float))],
                    _ROW,
                )
                tail = np.concatenate(tails)
                out = [(x, group, tail[i]) for x, i in _by_bucket(tail["h"], shape.word_buckets)]
                w, place = np.concatenate(asks, axis=1)
                o = np.argsort(place, kind="stable")
                for x, i in _by_bucket(w[o], shape.word_buckets):
                    w2, place2 = w[o][i], place[o][i]
                    cuts = np.flatnonzero(np.concatenate(([True], place2[1:] != place2[:-1])))
                    out += [(x + shape.word_buckets, int(place2[c]), np.unique(y)) for c, y in zip(cuts, np.split(w2, cuts[1:]), strict=True)]
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _, _ in out], pa.int32()), pa.array([g for _, g, _ in out], pa.int64()), pa.array([x.tobytes() for _, _, x in out], pa.binary()), pa.nulls(n, part.column(0).type), pa.nulls(n, pa.bool_())] + [pa.nulls(n, pa.int64())] * 3 + [pa.nulls(n, pa.float64())] * 2,
                    _ROW,
                )

    return run


def _places(shape: Shape, u, w) -> np.ndarray:
    """The buckets of pairs of any slice."""
    mixed = mix(u)
    k = (mixed % U64(shape.slices)).astype(np.int64)
    return shape.place(u, w, mixed, k).astype(np.uint64)


def _looked_up(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """A bucket's words and the tokens that ask for them -> sums by text."""
    h = np.frombuffer(b"".join(words["h"]), np.uint64)
    c = np.frombuffer(b"".join(words["c"]), np.int64)
    o = np.argsort(h)
    h, c = h[o], c[o]
    groups, data = [], []
    for group, blob in zip(asked["grp"], asked["data"], strict=True):
        x = np.frombuffer(blob, _TAIL)
        at, found = _found(h, x["h"])
        got = np.where(found, c[at], 0) if len(h) else np.zeros(len(x))
        r, back = np.unique(x["r"], return_inverse=True)
        out = np.zeros(len(r), _PART)
        out["r"] = r
        out["known"] = np.bincount(back, got > 0, minlength=len(r))
        out["base"] = np.bincount(back, np.log10(got + 0.5), minlength=len(r))
        groups.append(group)
        data.append(out.tobytes())
    return pd.DataFrame({"grp": pd.Series(groups, dtype="int64"), "data": data})


def _added(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """A group's texts and the sums that came back for them."""
    out = rows[["id", "held_out", "n_tokens", "n_known", "base_score", "score"]].copy()
    if len(parts) and len(rows):
        x = np.frombuffer(b"".join(parts["data"]), _PART)
        n = int(rows["r"].max()) + 1
        at = rows["r"].to_numpy(np.int64)
        out["n_known"] += np.bincount(x["r"], x["known"], minlength=n)[at].astype(np.int64)
        out["base_score"] += np.bincount(x["r"], x["base"], minlength=n)[at]
        out["score"] += np.bincount(x["r"], x["model"], minlength=n)[at]
    return out


def language_scores(
    docs: DataFrame,
    held_out: tuple[int, int] = (5, 1),
    burn_in: int = 2,
    samples: int = 2,
    inner: int = 2,
    parameters: tuple[float, float, float, float] | None = None,
    table_share: float = 2e-6,
    bucket_tokens: int = 600_000,
    slices: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every text by a model of those whose crc32(id as text) mod
    ``held_out[0]`` is not ``held_out[1]``.

    Tokens: A-Z lower-cased words between white space, then one end. Returns
    per row: id_col, held_out boolean, n_tokens, n_known (tokens seen in
    training), train_tokens (long), base_score (add-one-half unigram) and score
    (the model), both log10 probabilities of the text, double. Perplexity is
    10 ** (-score / n_tokens).

    ``samples`` states of the parent are kept after ``burn_in`` rounds; in each,
    restaurants make ``inner`` sweeps. ``parameters`` (strength, discount, the
    parent's strength, discount) are drawn each round if None.
    ``table_share``: words with that share of the tokens are broadcast;
    ``bucket_tokens`` tokens make a task; ``slices`` parts of the contexts are
    counted one after the other. None of these leaves out anything.

    Null texts are empty: the end alone. Null ids hash as the empty text.
    Repeated rows count and are repeated. Without training texts nothing is
    known and the model has one unknown type. Other columns, whatever their
    names, are ignored. Empty input: no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("held_out", remainder("id", held_out[0]) == held_out[1])
    kind = source.schema["id"].dataType.simpleString()
    numbered = stage_table(source.mapInArrow(_numbered, f"id {kind}, text string, held_out boolean, grp long, r int"), "texts", "zstd")
    train = numbered.where("not held_out").select("text")
    partial = stage_table(train.mapInArrow(_batch_counts, "h binary, c binary, distinct long, texts long"), "partial")
    size = partial.agg(F.sum("distinct").alias("distinct"), F.sum("texts").alias("texts")).first()
    ends = int(size.texts or 0)
    word_buckets = max(12, math.ceil((size.distinct or 0) / 400_000))
    words = partial.mapInArrow(_split(word_buckets), "bucket int, h binary, c binary").groupBy("bucket")
    words = stage_table(words.applyInPandas(_total, "bucket int, h binary, c binary, tokens long, types long"), "words")
    drop_table(partial)
    of = words.agg(*(F.sum(x).alias(x) for x in ("tokens", "types"))).first()
    tokens, types = int(of.tokens or 0) + ends, int(of.types or 0) + (ends > 0)

    # At most 1 / table_share words.
    floor = max(1, math.ceil(table_share * tokens))
    head = words.select("h", "c").mapInPandas(_above(floor), "h binary, c binary").collect()
    head_h, head_c = np.frombuffer(b"".join(r.h for r in head) + END.tobytes(), np.uint64), np.frombuffer(b"".join(r.c for r in head) + np.int64(ends).tobytes(), np.int64)
    o = np.argsort(head_h)
    hot = max(1000, floor, min(math.ceil(HOT * tokens), bucket_tokens // 4))
    buckets = slices * max(3, math.ceil(tokens / bucket_tokens / slices))
    shape = Shape(head_h[o], head_c[o], tokens, types, ends, buckets, word_buckets, slices, hot)
    sent = spark.sparkContext.broadcast(shape)
    parents, scoring = sampled(numbered, shape, sent, burn_in, samples, inner, seed, parameters)
    kept = spark.sparkContext.broadcast(scoring)

    row = f"bucket int, grp long, data binary, id {kind}, held_out boolean, r long, n_tokens long, n_known long, base_score double, score double"
    counted = stage_table(numbered.mapInArrow(_counted(sent, kept), row), "counted")
    asked = counted.where(F.col("bucket") < word_buckets).select("bucket", "grp", "data")
    parts = stage_table(words.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(_looked_up, "grp long, data binary"), "parts")
    drop_table(words)
    asks = counted.where(F.col("bucket") >= word_buckets).select((F.col("bucket") - word_buckets).alias("key"), F.col("grp").cast("int").alias("other"), F.col("data").alias("a"))
    answers = stage_table(parents.groupBy("key").cogroup(asks.groupBy("key")).applyInPandas(_answers(None), _PACKED), "answers")
    drop_table(parents)
    rows = stage_table(counted.where("bucket is null").select("grp", "id", "held_out", "r", "n_tokens", "n_known", "base_score", "score"), "rows")
    drop_table(counted)
    for k in range(slices):
        free_shuffles(spark)
        mine = answers.where(F.pmod("key", F.lit(slices)) == k)
        listed = numbered.mapInArrow(_listed(sent, kept, k), _TOKENS)
        scores = listed.groupBy("key").cogroup(mine.groupBy("key")).applyInPandas(_token_scores(sent, kept), "grp long, data binary")
        parts = parts.unionByName(stage_table(scores.groupBy("grp").applyInPandas(_summed_up, "grp long, data binary"), "scores"))
    for x in (numbered, answers):
        drop_table(x)
    free_shuffles(spark)
    out = rows.groupBy("grp").cogroup(parts.groupBy("grp")).applyInPandas(_added, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
