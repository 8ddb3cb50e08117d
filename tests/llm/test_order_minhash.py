import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packloom.llm.order_minhash import likeness, order_minhash, sketch


HASHES = {}


def hashes(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    HASHES.update({r.t: r.h for r in df.select("t", F.shiftrightunsigned(F.xxhash64("t"), 1).alias("h")).collect()})


def plain(text, functions=64, k=5, pick=2):
    """Order MinHash by its definition, with independent functions."""
    seen, grams = Counter(), []
    for i in range(max(len(text) - k, 0) + 1):
        g = text[i : i + k]
        grams.append((g, seen[g], i))
        seen[g] += 1
    out = []
    for f in range(functions):
        key = lambda g, n: hashlib.blake2b(f"{f} {n} {g}".encode(), digest_size=8).digest()  # noqa: E731, B023
        least = sorted(grams, key=lambda x: key(x[0], x[1]))[:pick]
        out.append(tuple(g for g, _, _ in sorted(least, key=lambda x: x[2])))
    return out


def test_likeness_is_that_of_independent_functions():
    """Against plain Order MinHash with 64 hash functions, over texts from
    equal to unlike, and falling with the number of edits."""
    rnd = random.Random(3)
    off, signed, last = [], [], []
    for n in (40, 120, 600):
        for edits in (0, 1, 3, 10, 40):
            both = []
            for _ in range(6):
                a = [rnd.choice("abcdefgh ") for _ in range(n)]
                b = list(a)
                for _ in range(edits):
                    b[rnd.randrange(len(b))] = rnd.choice("xyz")
                if edits == 10:
                    b = b[n // 2 :] + b[: n // 2]
                a, b = "".join(a), "".join(b)
                x, y = plain(a), plain(b)
                want = sum(p == q for p, q in zip(x, y, strict=True)) / 64
                got = likeness(sketch(a), sketch(b))
                both.append(got)
                off.append(abs(got - want))
                signed.append(got - want)
            last.append((n, edits, sum(both) / 6))
    assert sum(off) / len(off) < 0.08 and abs(sum(signed) / len(signed)) < 0.03
    for n in (40, 120, 600):
        by = {e: v for m, e, v in last if m == n}
        assert by[0] == 1 and by[0] > by[1] > by[3] > by[40]


def brute(rows):
    """In order of id (nulls last), then text's hash; the next row of the last is the first."""
    rows = sorted(((d is None, d or 0, t or "") for d, t in rows), key=lambda r: (*r[:2], HASHES.get(r[2], 0), r[2]))
    out = []
    for k, (null, d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        s = sketch(t)
        out.append((None if null else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), s.astype(">u4").tobytes().hex(), likeness(s, sketch(edited)), likeness(s, sketch(after))))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    got = order_minhash(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got), key=repr)


@pytest.mark.parametrize("part_chars", [8_000_000, 20_000, 3000])
def test_matches_brute_force(spark, sf, part_chars):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    hashes(spark, ["", "zwei", "a", *(t or "" for d, t in rows if d in (7, 8)), *(f"none {k} " * 30 for k in range(40))])
    rows += [(-5, None), (7, ""), (7, "zwei"), (7, "zwei"), (None, "a"), (None, None), (10**9, "x" * 50_000), (10**9 + 1, "🙂🙂é" * 3)]
    rows += [(None, f"none {k} " * 30) for k in range(40)] + [(8, f"none {k} " * 30) for k in range(40)]
    assert run(spark, rows, part_chars=part_chars) == brute(rows)


def test_one_row_and_none(spark):
    assert run(spark, [(1, "abcdef")]) == brute([(1, "abcdef")])
    assert run(spark, []) == []


def test_sensitive_to_order_and_edits():
    words = [f"w{k}" for k in range(300)]
    a = " ".join(words)
    swapped = " ".join(words[150:] + words[:150])
    one = " ".join(words[:100] + ["other"] + words[101:])
    assert likeness(sketch(a), sketch(a)) == 1
    assert likeness(sketch(a), sketch(one)) > likeness(sketch(a), sketch(swapped))
    assert likeness(sketch(""), sketch("")) == 1 and likeness(sketch(""), sketch("a")) == 0
    assert likeness(sketch("ab" * 40), sketch("ab" * 20)) < 1
