import zlib
from itertools import product

import numpy as np

from packloom.llm.quality import _isotonic, quality_scores, statistics
from packloom.llm.toxicity import _SPAN, Crf, _mean_loss, toxicity_scores


def auc(score, y):
    o = np.argsort(np.argsort(score))
    return (o[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def held_out_auc(spark, d, f, label):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = f(docs, labels).toPandas()
    assert got["score"].between(0, 1).all() and len(got) == docs.count()
    x = labels.toPandas().merge(got, on="doc_id")
    x = x[x["held_out"]]
    return auc(x["score"].to_numpy(), x[label].to_numpy()), got


def test_held_out_quality(spark):
    score, got = held_out_auc(spark, "/root/testdata/sf0.01", quality_scores, "quality")
    assert score > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got.itertuples())


def test_held_out_toxicity(spark):
    score, got = held_out_auc(spark, "/root/testdata/sf0.01", toxicity_scores, "toxic")
    assert score > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got.itertuples())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (2, "İdiot! idiot"), (3, "x" * 300_000), (3, "x" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], labels.schema)
    for f in (quality_scores, toxicity_scores):
        for marks in (labels, none):
            got = f(docs, marks).toPandas()
            assert len(got) == 6 and got["score"].between(0, 1).all()
        assert f(docs.limit(0), labels).count() == 0


def test_statistics_are_finite_and_isotonic_is_monotone():
    import pyarrow as pa

    x = statistics(pa.array(["", None, " ", "a", "A a\n\nb!", "é" * 50]))
    assert x.shape == (6, 20) and np.isfinite(x).all() and (x[0] == x[1]).all()
    got = _isotonic(np.array([2, 1, 4, 1.0]), np.array([1, 1, 1, 1.0]))
    assert (np.diff(got) >= -1e-12).all() and np.isclose(got[:3], 3 / 7).sum() in (0, 2, 3)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        crf = Crf(["a", "b"])
        crf.theta = rng.normal(size=6)
        crf.ready()
        words = rng.choice(["a", "b", "z", "z", "z"], int(rng.integers(1, 9))).tolist()
        ids = [crf.index.get(w, 0) for w in words]
        emit, trans = crf._parts(crf.theta)
        total, hit = 0.0, np.zeros(len(words))
        for y in product((0, 1), repeat=len(words)):
            s = np.exp(sum(emit[k] * v for k, v in zip(ids, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += s
            hit += s * np.array(y)
        at = [k for k, v in enumerate(ids) if v]
        assert np.allclose(crf.marginals(len(words), at, [ids[k] for k in at]), hit[at] / total)
        tags = crf.tagged(len(words), at, [ids[k] for k in at])
        p = hit / total
        assert all(np.isclose(p[k], v) and v > 0.5 for k, v in tags.items())
        # Every token over one half that touches a tagged one is tagged.
        assert all(k in tags for k in range(len(words)) if p[k] > 0.5 and (ids[k] or k - 1 in tags or k + 1 in tags))


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    crf = Crf(["a", "b", "c"])
    ids, y = rng.integers(0, 4, (5, 32)), rng.integers(0, 2, (5, 32))
    real = np.arange(32) < rng.integers(1, 33, 5)[:, None]
    theta = rng.normal(size=7)
    _, g = crf.gradient(theta, ids, y * real, real)
    for k in range(7):
        e = np.eye(7)[k] * 1e-5
        assert np.isclose(g[k], (crf.gradient(theta + e, ids, y * real, real)[0] - crf.gradient(theta - e, ids, y * real, real)[0]) / 2e-5, atol=1e-5)


def test_equal_windows_weigh_what_they_count(spark):
    """All windows count, collapsed or not, on the driver or on executors."""
    rng = np.random.default_rng(2)
    crf = Crf(["a", "b", "c"])
    ids, y = rng.integers(0, 4, (6, _SPAN)), rng.integers(0, 2, (6, _SPAN))
    n, weight = rng.integers(1, _SPAN + 1, 6), np.array([1, 50, 3, 1, 7, 2])
    theta, real = rng.normal(size=7), np.arange(_SPAN) < n[:, None]
    k = np.repeat(np.arange(6), weight)
    want = crf.gradient(theta, ids[k], (y * real)[k], real[k])[1]
    rows = [(bytearray(i.astype(np.int32).tobytes()), int(((v * r) << np.arange(_SPAN)).sum()), int(m), int(w)) for i, v, r, m, w in zip(ids, y, real, n, weight)]
    df = spark.createDataFrame(rows, "ids binary, y long, n int, weight long")
    for on_driver in (100, 0):
        assert np.allclose(_mean_loss(crf, df, on_driver)(theta)[1], want)


def test_words_late_in_long_texts_are_learnt(spark):
    """The only toxic word comes after many windows of ordinary ones."""
    mild = " ".join(f"mild{k} " + "filler " * 40 for k in range(8))
    docs = [(k, mild + ("zorg " if k % 4 == 0 else "end ")) if k % 4 in (0, 1) else (k, "filler " * 60) for k in range(120)]
    docs += [(k, "filler " * 20 + "zorg " + "filler " * 20) for k in range(1000, 1030)]
    labels = [(k, int(k % 4 == 0)) for k, _ in docs[:120]]
    got = toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    late = got[got["doc_id"] >= 1000]
    assert late["spans"].map(len).eq(1).all() and late["score"].min() > got[(got["doc_id"] % 4 == 2) & (got["doc_id"] < 120)]["score"].max()


def test_scores_match_a_plain_reading_of_the_model(spark):
    """Scores and spans again from the trained parameters, by forward-backward
    over all tokens."""
    from packloom.llm.toxicity import _tokens, fit

    rng = np.random.default_rng(4)
    text = lambda bad: " ".join(rng.choice(["zorg", "blah", "Über", "and", "so", "on"], int(rng.integers(1, 70)), p=[0.2 * bad, 0.1 * bad, 0.2, 0.3 - 0.1 * bad, 0.3 - 0.1 * bad, 0.2 - 0.1 * bad]))
    rows = [(k, text(k % 3 == 0), int(k % 3 == 0)) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(df.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").selectExpr("text", "toxic as label"))
    got = toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).toPandas().set_index("doc_id")
    emit, trans = model._parts(model.theta)
    for d, t, _ in rows:
        words = _tokens(t)
        ids = [model.index.get(w, 0) for w in words]
        a, z = np.zeros((len(ids), 2)), np.zeros((len(ids), 2))
        for k, v in enumerate(ids):
            a[k] = [0, emit[v]] if k == 0 else np.logaddexp(a[k - 1][0] + trans[0], a[k - 1][1] + trans[1]) + [0, emit[v]]
        for k in range(len(ids) - 2, -1, -1):
            z[k] = np.logaddexp(trans[:, 0] + z[k + 1][0], trans[:, 1] + emit[ids[k + 1]] + z[k + 1][1])
        p = 1 / (1 + np.exp((a + z)[:, 0] - (a + z)[:, 1]))
        at = [k for k, v in enumerate(ids) if v]
        top = np.clip(max(p[at]), 1e-6, 1 - 1e-6) if at else 0
        want = model.probability(np.log(top / (1 - top)) if at else -12.0, p[at].sum())
        assert np.isclose(got.loc[d, "score"], want, rtol=1e-6)
        spans = [t[s["start"] : s["end"]].lower() for s in got.loc[d, "spans"]]
        assert spans == [words[k] for k in range(len(ids)) if p[k] > 0.5]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(k, "bad zorg" if k % 2 else "fine day", 1, "x", 0.5) for k in range(12)], "doc_id long, text string, label int, id string, score double")
    labels = spark.createDataFrame([(k, k % 2, k % 2, "t") for k in range(12)], "doc_id long, toxic int, quality int, text string")
    for f in (quality_scores, toxicity_scores):
        got = f(docs, labels)
        assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == 12
