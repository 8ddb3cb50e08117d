import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from packloom.llm.decontamination import Index, leaks, passage_words, split_item, without_leaks


def items(spark, sf):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def test_wand_finds_all_above_threshold(spark, sf):
    index = Index(items(spark, sf), 0.5, 0.5, 3)
    rng = np.random.default_rng(0)
    found = 0
    for n in range(400):
        block = index.blocks[n % len(index.blocks)]
        terms = rng.integers(0, len(index.terms), int(rng.integers(3, 80)))
        if n % 2:
            terms = np.concatenate([terms, index.locate(block.items[int(rng.integers(len(block.items)))].words)])
        terms = np.unique(terms).tolist()
        score = defaultdict(float)
        for t in terms:
            for k, w in zip(block.docs.get(t, []), block.weights.get(t, [])):
                score[k] += w
        want = {k: v for k, v in score.items() if v >= 0.5 - 1e-9}
        got = dict(block.search(terms))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        found += len(want)
    assert found > 100


WORD = re.compile(rb"[^\x09-\x0d\x20!-/:-@\[-`{-~]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def share(part, passage, whole):
    """How many of the part's runs of three words the passage has."""
    w = words(part)
    if not w:
        return 1.0
    runs = lambda x, n: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
    want = runs(w, min(3, len(w)))
    have = set().union(*(runs(passage, n) for n in ({min(3, len(whole))} if len(want) > 1 else (1, 2, 3))))
    return len(want & have) / len(want)


def brute(bench, texts, threshold=0.5, overlap=0.5):
    """BM25 and overlap by their definitions, every passage against every item."""
    all_words = {i: words(t) for i, t in bench if words(t)}
    df = Counter(w for ws in all_words.values() for w in set(ws))
    n, mean = len(all_words), sum(map(len, all_words.values())) / max(len(all_words), 1)

    def weights(ws):
        tf = Counter(ws)
        return {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in tf.items()}

    out = []
    for text in texts:
        h, found = words(text or ""), set()
        for i, t in bench:
            if i not in all_words:
                continue
            weigh = weights(all_words[i])
            q, a = split_item(t)
            size = passage_words(len(all_words[i]))
            for at in range(0, max(len(h) - size, 0) + size // 2, size // 2):
                p = h[at : at + size]
                if sum(weigh.get(w, 0) for w in set(p)) / sum(weigh.values()) >= threshold - 1e-9 and share(q, p, all_words[i]) >= overlap and share(a, p, all_words[i]) >= overlap:
                    found.add(i)
        out.append(found)
    return out


def test_passages_match_brute_force_and_planted_items(spark, sf):
    bench = items(spark, sf)
    index = Index(bench, 0.5, 0.5, 3)
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()]
    planted = [f"{d[:400]} {bench[k][1].replace(",", " ;")} {d[400:800]}" for k, d in enumerate(docs[:10])]
    texts = [*docs[:15], *planted, None, "", "!!"]
    got = [set(m) for m in index.matches(pa.array(texts))]
    assert got == brute(bench, texts)
    assert all(bench[k][0] in got[15 + k] for k in range(10))


def test_tables(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    text = bench.first().text
    rows = [(1, text, "x"), (1, text, "x"), (2, "clean words only", "y"), (3, None, None), (None, text, "z"), (4, "w " * 100_000 + text, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted((-1 if r.doc_id is None else r.doc_id) for r in leaks(docs, bench).collect())
    assert got == [-1, 1, 1, 4]
    rows = lambda **more: sorted((r.doc_id or -1, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in leaks(docs, bench, **more).collect())
    assert rows() == rows(most_chars=2500)  # in parts: the same scores
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert leaks(docs, bench.limit(0)).count() == 0 and leaks(docs.limit(0), bench).count() == 0 and without_leaks(docs, bench.limit(0)).count() == 6


def test_split():
    assert split_item("What is it? A cat.") == ("What is it?", " A cat.")
    assert split_item("One. Two. Three.") == ("One. Two.", "Three.")
    assert split_item("a b c d e f") == ("a b c d", "e f")


def test_question_alone_is_no_leak():
    bench = [(1, "Which planet is the third one from the sun in our system? It is the Earth of course")]
    index = Index(bench, 0.5, 0.5, 3)
    asked = "some words and Which planet is the third one from the sun in our system, who knows"
    got = [set(m) for m in index.matches(pa.array([asked, asked + " It is the Earth of course"]))]
    assert got == [set(), {1}] == brute(bench, [asked, asked + " It is the Earth of course"])
