import re
from itertools import combinations

import numpy as np
import pytest

from packloom.llm import jaccard_join as module
from packloom.llm.jaccard_join import jaccard_join, links_among, links_within

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def run(spark, rows, n, num, den, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join(df, n, (num, den), **more).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("n,num,den,more", [(3, 90, 100, {}), (5, 8, 10, {"in_one_task": 3, "task_shingles": 500}), (3, 9, 10, {"hub_list": 4, "long_list": 3, "task_shingles": 300, "in_one_task": 2}), (1, 1, 2, {}), (2, 2, 3, {})])
def test_matches_brute_force(spark, sf, n, num, den, more):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = np.random.default_rng(1)
    base = rows[3][1].split()[:90]
    for k in range(60):  # a large group of near copies, each changed in another place
        w = list(base)
        w[int(rng.integers(len(w)))] = f"x{k}"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "One"), (20_004, "one"), (20_005, "one two"), (20_006, "One  two"), (20_007, rows[5][1]), (20_007, rows[5][1])]
    rows += [(20_010, "b9 a9"), (20_011, "a9"), (20_012, "c9 d9 e9"), (20_013, "c9 d9")]  # few shingles in common
    rows += [(20_008, "a b c " * 30000), (20_009, "a b c " * 20000)]
    want = brute(rows, n, num, den)
    assert run(spark, rows, n, num, den, **more) == want
    assert sum(a != c for a, _, c in want) > 40


def test_empty_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d", 1), (None, None, 2), (3, "a b c d", 3)], "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in jaccard_join(df).collect()}
    assert got == {(None, 3), (None, None), (3, 3)}


def test_links_within_changes_its_largest_component():
    rng = np.random.default_rng(0)
    for _ in range(30):
        hubs = [np.sort(rng.choice(10_000, 60, replace=False)).astype(np.uint64) for _ in range(4)]
        sets = []
        for h in hubs:
            for _ in range(int(rng.integers(1, 12))):
                x = h.copy()
                x[rng.integers(60)] = rng.integers(10_000, 20_000)
                sets.append(np.unique(x))
        order = rng.permutation(len(sets))
        sets = [sets[i] for i in order]
        root = list(range(len(sets)))

        def find(root, x):
            while root[x] != x:
                x = root[x]
            return x

        full = list(root)
        for i, j in combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 10 * both >= 9 * (len(sets[i]) + len(sets[j]) - both):
                full[find(full, i)] = find(full, j)
        for links in (links_within, links_among, lambda *x: links_among(*x, long_list=3)):
            root = list(range(len(sets)))
            for i, j in links(sets, 9, 10):
                root[find(root, i)] = find(root, j)
            pairs = combinations(range(len(sets)), 2)
            assert all((find(root, i) == find(root, j)) == (find(full, i) == find(full, j)) for i, j in pairs)


def test_copies_without_an_id_or_a_set_are_dealt_out(spark):
    """A class of more than a thousand copies, and as many rows without words."""
    rows = [(k, "one two three four five six") for k in range(1500)] + [(2000 + k, None) for k in range(1500)] + [(5000, "one two three four five")]
    assert run(spark, rows, 1, 8, 10) == [(d, len((t or "").split()), 0 if t else d) for d, t in rows]


def test_shingles_in_common_by_chance_make_no_large_component(spark, monkeypatch):
    """As in a large corpus, where every shingle is in some other texts too:
    few texts have a candidate, not all of them one another."""
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(23, size=int(rng.integers(60, 240))))) for k in range(500)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(5)]
    held = []
    tasks = module._tasks
    monkeypatch.setattr(module, "_tasks", lambda cands, *more: held.append(cands.count()) or tasks(cands, *more))
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert 10 <= held[0] <= 100
