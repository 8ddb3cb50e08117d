import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from packloom.llm import seating
from packloom.llm.pitman_yor import language_scores

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


QUICK = {"burn_in": 0, "samples": 1, "slices": 1}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return language_scores(df, **more).toPandas()


def test_counts_and_baseline_match_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "one One\tONE"), (10**6 + 2, "one One\tONE"), (None, "x y"), (10**6 + 3, "long " * 40_000)]
    mod = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5
    c, n = Counter(), 0
    for d, t in rows:
        if mod(d) != 1:
            w = words(t)
            c.update(w)
            c[None] += 1
            n += len(w) + 1
    want = []
    for d, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (len(c) + 1))) for x in w)
        want.append((-1 if d is None else d, mod(d) == 1, len(w), sum(c[x] > 0 for x in w), n, round(base, 4)))
    for more in (QUICK, {**QUICK, "table_share": 0.01, "bucket_tokens": 5000, "slices": 2}):
        got = run(spark, rows, **more)
        have = [(-1 if np.isnan(r.doc_id) else int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.itertuples()]
        assert sorted(have) == sorted(want)
        assert (got["score"] < 0).all()
        held = got[got["held_out"]]
        assert held["score"].sum() > held["base_score"].sum()


def partitions(n):
    """All ways to put n people at tables."""
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield [*p[:i], p[i] + 1, *p[i + 1 :]]
        yield [*p, 1]


def test_tables_follow_the_enumerated_law():
    d, theta, rest, base, n = 0.6, 0.8, 3, 0.2, 5
    law = np.zeros(n + 1)
    for p in partitions(n):
        weight = math.prod(math.prod(k - d for k in range(1, size)) for size in p)
        law[len(p)] += weight
    assert np.allclose(law[1:], np.exp(seating.log_stirling(d, 8)[n, 1 : n + 1]))
    law *= [math.prod((theta + d * (rest + i)) * base for i in range(t)) for t in range(n + 1)]
    rng = np.random.default_rng(0)
    m = 40_000
    t = seating.draw(np.full(m, n), np.full(m, rest), np.full(m, base), theta, d, rng)
    assert np.abs(np.bincount(t, minlength=n + 1) / m - law / law.sum()).max() < 0.01
    assert (seating.draw(np.array([0, 1]), np.zeros(2), np.ones(2), 1.0, 0.5, rng) == [0, 1]).all()
    two = seating.draw(np.full(m, 2), np.full(m, rest), np.full(m, base), theta, d, rng)
    x = (theta + d * (rest + 1)) * base
    assert abs((two == 2).mean() - x / (x + 1 - d)) < 0.01


def test_many_customers():
    """The short form of the law, and the law by ranges, against the whole one."""
    rng = np.random.default_rng(1)
    for n, law in ((900, seating.draw), (3000, seating.crowd)):
        for rest, base, d in ((40, 0.02, 0.7), (1000, 0.05, 0.8), (10, 0.9, 0.5), (3000, 0.01, 0.95)):
            t = np.arange(1, n + 1)
            p = seating.log_stirling(d, n)[n, 1:] + np.cumsum(np.log((1.0 + d * (rest + t - 1)) * base))
            p = np.exp(p - p.max())
            p /= p.sum()
            mean = (t * p).sum()
            got = law(np.full(4000, n), np.full(4000, rest), np.full(4000, base), 1.0, d, rng)
            assert abs(got.mean() / mean - 1) < 0.04 and abs(got.std() / np.sqrt((t * t * p).sum() - mean**2) - 1) < 0.08


def test_parameters_are_found_again():
    """Seatings made customer by customer give back their strength and discount."""
    rng = np.random.default_rng(2)
    theta, d = 2.0, 0.6
    n, t, tables, customers = [], [], [], []
    for _ in range(400):
        sizes, dishes = [], []
        for i in range(120):
            p = np.array([s - d for s in sizes] + [theta + d * len(sizes)]) / (theta + i)
            k = rng.choice(len(p), p=p)
            if k == len(sizes):
                sizes.append(0)
                dishes.append(int(rng.integers(0, 12)))
            sizes[k] += 1
        by = Counter(dishes)
        n += [sum(s for s, x in zip(sizes, dishes, strict=True) if x == w) for w in by]
        t += list(by.values())
        tables.append(len(sizes))
        customers.append(120)
    got = seating.sample_parameters(seating.sums(n, t, tables, customers), rng)
    assert abs(got[1] - d) < 0.11 and 0.5 <= got[0] <= 8


class Franchise:
    """Brute force: every customer has a seat; one at a time leaves and sits
    down again, in the parent too."""

    def __init__(self, pairs, kinds, theta, d, theta0, d0, seed=0):
        self.rng = random.Random(seed)
        self.p, self.kinds = (theta, d, theta0, d0), kinds
        self.rooms, self.parent, self.who = {}, {}, []
        for u, w in pairs:
            self.who.append((u, w, self.sit(u, w)))

    def base(self, w):
        _, _, theta, d = self.p
        tables = [x for v in self.parent.values() for x in v]
        mine = self.parent.get(w, [])
        return (sum(mine) - d * len(mine) + (theta + d * len(tables)) / self.kinds) / (theta + sum(tables))

    def prob(self, u, w):
        theta, d = self.p[:2]
        room = self.rooms.get(u, {})
        mine = [x[0] for x in room.get(w, [])]
        n, t = sum(x[0] for v in room.values() for x in v), sum(len(v) for v in room.values())
        return (sum(mine) - d * len(mine) + (theta + d * t) * self.base(w)) / (theta + n)

    def sit(self, u, w):
        theta, d, theta0, d0 = self.p
        room = self.rooms.setdefault(u, {})
        mine = room.setdefault(w, [])
        t = sum(len(v) for v in room.values())
        weights = [x[0] - d for x in mine] + [(theta + d * t) * self.base(w)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k < len(mine):
            mine[k][0] += 1
            return mine[k]
        up = self.parent.setdefault(w, [])
        all_tables = sum(len(v) for v in self.parent.values())
        weights = [x - d0 for x in up] + [(theta0 + d0 * all_tables) / self.kinds]
        j = self.rng.choices(range(len(weights)), weights)[0]
        if j == len(up):
            up.append(0)
        up[j] += 1
        mine.append([1])
        return mine[-1]

    def sweep(self):
        for i in self.rng.sample(range(len(self.who)), len(self.who)):
            u, w, table = self.who[i]
            table[0] -= 1
            if not table[0]:
                self.rooms[u][w] = [x for x in self.rooms[u][w] if x is not table]
                up = self.parent[w]
                j = self.rng.choices(range(len(up)), up)[0]
                up[j] -= 1
                if not up[j]:
                    del up[j]
            self.who[i] = (u, w, self.sit(u, w))


def test_scores_match_a_brute_force_seating(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(9)]
    rows = [(k, " ".join(rnd.choices(vocabulary, [9, 7, 5, 3, 2, 1, 1, 1, 1], k=rnd.randint(0, 9)))) for k in range(24)]
    rows += [(100 + k, t) for k, t in enumerate(("w0 w1 w2 w3", "w8 w8", "new w0", "", "w4 new2 w5"))]
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    pairs = lambda t: list(zip([None, *t.split()], [*t.split(), ""], strict=True))
    seen = [p for _, t in learnt for p in pairs(t)]
    types = {w for _, w in seen}
    parameters = (1.0, 0.5, 2.0, 0.5)
    f = Franchise(seen, len(types) + 1, *parameters)
    total, kept = {}, 0
    for k in range(260):
        f.sweep()
        if k >= 20 and k % 2 == 0:
            kept += 1
            for _, t in rows:
                for u, w in pairs(t):
                    total.setdefault((u, w), []).append(f.prob(u, w))
    mean = {p: np.mean(v) for p, v in total.items()}
    want = {d: sum(math.log10(mean[p]) for p in pairs(t)) for d, t in rows}
    got = run(spark, rows, parameters=parameters, burn_in=2, samples=8, slices=1)
    for r in got.itertuples():
        assert abs(r.score - want[r.doc_id]) < 0.04 * r.n_tokens + 0.02 * abs(want[r.doc_id]), (r, want[r.doc_id])


def test_empty(spark):
    assert len(run(spark, [], **QUICK)) == 0
    got = run(spark, [(1, "a b")], held_out=(1, 0), **QUICK)  # nothing to learn from
    assert got["n_known"].tolist() == [0] and got["train_tokens"].tolist() == [0] and abs(got["base_score"][0]) < 1e-9


def test_rare_contexts_shape_their_words(spark):
    """Every word is a context, however rare: what follows it in training is
    likelier after it, though one filler word is most of the tokens."""
    filler = " ".join(["the"] * 3000)
    rows = [(k, f"qa{k} zb{k} qa{k} zb{k} {filler}") for k in range(60)]
    kept = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 != 1]
    a, b = kept[:2]
    tests = [(1000 + k, t) for k in range(40) for t in (f"qa{a} zb{a}", f"qa{a} zb{b}")]
    tests = [r for r in tests if zlib.crc32(str(r[0]).encode()) % 5 == 1]
    got = run(spark, rows + tests, **QUICK).set_index("doc_id")["score"]
    follows = [got[d].iloc[0] - got[d].iloc[1] for d in {r[0] for r in tests}]
    assert min(follows) > 1


def test_buckets_slices_and_broadcasts_do_not_matter(spark, sf):
    """Pairs dealt out by pair, rare words asked for, common pairs broadcast:
    the same model but for the draws."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = language_scores(docs, **QUICK).toPandas().sort_values("doc_id")
    b = language_scores(docs, **{**QUICK, "slices": 3}, table_share=0.002, bucket_tokens=6000, seed=9).toPandas().sort_values("doc_id")
    assert (a["n_known"].to_numpy() == b["n_known"].to_numpy()).all()
    assert abs(a["score"].sum() / b["score"].sum() - 1) < 0.02
    assert np.corrcoef(a["score"] / a["n_tokens"], b["score"] / b["n_tokens"])[0, 1] > 0.99


def test_clashing_names_and_text_ids(spark):
    df = spark.createDataFrame([("a", "x y", 1, 2, True), ("b", None, 3, 4, None)], "doc_id string, text string, grp int, score int, held_out boolean")
    got = language_scores(df, **QUICK).toPandas()
    assert sorted(got["doc_id"]) == ["a", "b"] and got.columns.tolist() == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
