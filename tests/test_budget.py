import random

import pytest

from packloom.operators import budget as B


def rows(*sections, pack=1):
    return [(pack, k, p, f"s{k}", "x" * (t * 4), t) for k, (p, t) in enumerate(sections)]


def run(spark, data, limit, how, tokenizer="chars-div4"):
    df = spark.createDataFrame(data, "pack_id long, ord long, priority int, name string, content string, token_estimate long")
    got = B.allocate(df, B.Budget(limit, 0, how), tokenizer=tokenizer).collect()
    return {(r.pack_id, r.ord): r for r in got}


CASES = [
    (((1, 200), (2, 500), (3, 400)), 800, "priority", ["kept", "kept", "dropped"]),
    (((0, 5000), (1, 100)), 1000, "priority", ["kept", "dropped"]),
    (((0, 50), (1, 100), (2, 100)), 0, "priority", ["kept", "dropped", "dropped"]),
    (((1, 300), (2, 500), (3, 100)), 700, "priority", ["kept", "dropped", "kept"]),
    (((1, 200), (2, 1500)), 800, "truncate", ["kept", "truncated"]),
    (((1, 700), (2, 0), (3, 50)), 700, "truncate", ["kept", "dropped", "dropped"]),
    (((1, 400), (2, 600)), 500, "proportional", ["truncated", "truncated"]),
    (((1, 100), (2, 200)), 1000, "proportional", ["kept", "kept"]),
    (((0, 100), (1, 500)), 200, "proportional", ["kept", "truncated"]),
    (((1, 1), (2, 10000)), 100, "proportional", ["dropped", "truncated"]),
]


@pytest.mark.parametrize("sections,limit,how,want", CASES)
def test_cases(spark, sections, limit, how, want):
    got = run(spark, rows(*sections), limit, how)
    assert [got[1, k].outcome for k in range(len(sections))] == want
    assert sum(r.final_tokens for r in got.values() if r.priority) <= max(limit, 0)


def plain(sections, limit, how):
    """One pack, one section at a time."""
    out = {k: ("kept", t, "exempt") for k, (p, t) in enumerate(sections) if p == 0}
    room = max(limit - sum(t for p, t in sections if p == 0), 0)
    rest = sorted((p, k, t) for k, (p, t) in enumerate(sections) if p)
    count = lambda chars: -(-chars // 4)
    used, cut, total = 0, False, sum(t for _, _, t in rest)
    for _, k, t in rest:
        left = max(room - used, 0)
        if how == "priority":
            ok = used + t <= room
            out[k] = ("kept", t, None) if ok else ("dropped", 0, "priority budget exhausted")
            used += t * ok
        elif how == "truncate":
            if cut:
                out[k] = ("dropped", 0, "truncate stops after first overflow")
            elif left == 0:
                out[k] = ("dropped", 0, "truncate budget exhausted")
            elif t <= left:
                out[k] = ("kept", t, None)
                used += t
            else:
                out[k] = ("truncated", count(int(4 * t * (left / max(t, 1)) * 0.95) + len(B.TRUNCATED)), "hard truncated to remaining budget")
                cut = True
        elif total <= room or total == 0:
            out[k] = ("kept", t, None)
        else:
            target = int(t * (room / total))
            body = target - count(len(B.SCALED))
            if target == 0:
                out[k] = ("dropped", 0, "proportional share rounded to zero")
            elif body <= 0:
                out[k] = ("dropped", 0, "proportional share cannot fit truncation marker")
            else:
                out[k] = ("truncated", count(int(4 * t * body / max(t, 1)) + len(B.SCALED)), "proportionally truncated")
    return out


def test_random_packs_match_a_plain_version(spark):
    rng = random.Random(5)
    packs = [[(rng.choice([0, 1, 2, 2, 3]), rng.choice([0, 1, 5, 40, 200])) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    data = [r for n, s in enumerate(packs) for r in rows(*s, pack=n)]
    for how in B.STRATEGIES:
        got = run(spark, data, 150, how)
        for n, s in enumerate(packs):
            assert {k: (got[n, k].outcome, got[n, k].final_tokens, got[n, k].reason) for k in range(len(s))} == plain(s, 150, how), (how, s)


def test_effective_and_empty(spark):
    assert B.Budget().effective == 6000 and B.Budget(10, 20).effective == 0
    assert run(spark, [], 100, "priority") == {}
    with pytest.raises(ValueError):
        run(spark, rows((1, 1)), 1, "other")


def test_equal_places_and_clashing_names(spark):
    rows = [(1, 1, 1, "a", "x" * 8, 2, "f"), (1, 1, 1, "b", "y" * 8, 2, "f"), (1, 1, 1, "b", "y" * 8, 2, "f"), (1, 2, 1, "c", "z" * 400, 100, "f")]
    df = spark.createDataFrame(rows, "pack_id long, ord long, priority int, name string, content string, token_estimate long, fits string")
    for how in B.STRATEGIES:
        got = B.allocate(df, B.Budget(6, 0, how)).collect()
        assert len(got) == 4 and sum(r.final_tokens for r in got) <= 6 + 3 * 13
    assert sorted(r.name for r in B.priority(df, 4).where("outcome = 'kept'").collect()) == ["a", "b"]
    assert B.priority(df.limit(0), 4).count() == 0
