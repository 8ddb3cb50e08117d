import random
import zlib
from array import array

import pytest

from packloom.llm.packing import Encoder, best_fit_packing, sum_of_squares

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizers_library():
    rng = random.Random(1)
    bits = [" ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "the", "it's", "don’t", "12", "½", "é", "日本", "🙂", "<|endoftext|>", "a_b", "!!", "%%%", "\x85", "e\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(4000)] + ["", " ", "a " * 3000]
    e = Encoder(PATH, most=50)
    for t, want in zip(texts, reference(texts)):
        assert list(array("I", e.encode(t))) == want, repr(t)


def test_pieces_and_sequences(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6, ""), (None, "a b"), (10**6 + 1, "word " * 9000), (10**6 + 2, rows[0][1]), (10**6 + 2, rows[0][1])]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), PATH).toPandas()
    want = []
    for (d, t), ids in zip(rows, reference([t or "" for _, t in rows])):
        ids = [*ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want.append((-1 if d is None else d, k, a, z - a, zlib.crc32(array("I", ids[a:z]).tobytes())))
    have = list(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"]))
    assert sorted(have) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for o, n in zip(g["offset"], g["length"]):
            assert o == at
            at += n
        assert at <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) * 1.02 + 1
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_sum_of_squares_rule():
    import numpy as np

    rng = random.Random(2)
    for _ in range(50):
        cap, items = 12, [rng.randrange(1, 13) for _ in range(30)]
        bins, offsets = sum_of_squares(np.array(items), cap)
        gaps: dict[int, int] = {}
        for k, s in enumerate(items):
            cost = lambda g: sum(v * v for v in np.bincount([x for x in g.values() if x > 0], minlength=1))
            options = {b: cost(gaps | {b: r - s}) for b, r in gaps.items() if r >= s} | {-1: cost(gaps | {-1: cap - s})}
            b = int(bins[k])
            assert options[b if b in gaps else -1] == min(options.values())
            assert offsets[k] == cap - gaps.get(b, cap)
            gaps[b] = gaps.get(b, cap) - s
