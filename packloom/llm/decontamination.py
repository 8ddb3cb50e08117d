"""Benchmark decontamination: BM25 with block-max WAND, then overlap.

The inverted index covers the test items; every passage of every training
document is a query. Term weights are divided by the score of the item against
itself, so a score is the share of the item that the passage holds and one
threshold serves all items. Items are kept in blocks of similar length, each
with its own upper bounds; a passage is as long as the item's length asks for,
whatever block it is in. A passage that the bounds cannot lift to the
threshold in a block is passed over there - the first test of WAND, done for
all passages of a batch at once, with the terms that together never decide
(at most half the threshold in any item) left out and charged at their most -
and the rest go through block-max WAND proper. What is retrieved must overlap
both the question and the answer.

The index is broadcast, so items come in parts of bounded text. Document
frequencies, the number of items and their mean length are those of the whole
benchmark, however it is cut.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, chain, stage_table, text_chunks, words_of

BLOCK = 16


@dataclass
class Item:
    item_id: int
    words: np.ndarray  # hashes, in order
    question: np.ndarray  # hashes of its runs of words
    answer: np.ndarray


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]), MARKS)[0]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of a test item: the answer follows the last question
    mark; without one, it is the last sentence; without two sentences, the
    last third of the words."""
    text = text.strip()
    if 0 <= (at := text.rfind("?")) < len(text) - 1:
        return text[: at + 1], text[at + 1 :]
    sentences = [s for s in re.split(r"(?<=[.!])\s+", text) if s]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def passage_words(n: int) -> int:
    """Words of the passages that items of n words are looked for in: twice the
    item's, rounded up by a quarter at most."""
    return max(16, 2 * math.ceil(1.25 ** math.ceil(math.log(n) / math.log(1.25) - 1e-9)))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    return np.unique(chain(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)


class Block:
    """Postings of a few items in order of item, in runs of ``BLOCK`` with
    their largest weight."""

    def __init__(self, items: list[tuple[Item, np.ndarray, np.ndarray]], n_terms: int, threshold: float):
        self.threshold = threshold
        self.items = [x[0] for x in items]
        self.window = passage_words(len(self.items[0].words))  # all alike
        lists: dict[int, list[tuple[int, float]]] = {}
        for k, (_, terms, weights) in enumerate(items):
            for t, x in zip(terms.tolist(), weights.tolist(), strict=True):
                lists.setdefault(t, []).append((k, x))
        self.docs = {t: [k for k, _ in x] for t, x in lists.items()}
        self.weights = {t: [w for _, w in x] for t, x in lists.items()}
        self.tops = {t: [max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for t, x in self.weights.items()}
        self.best = np.zeros(n_terms)
        for t, x in self.weights.items():
            self.best[t] = max(x)
        # Terms that never decide: the most spread ones, while no item gets
        # more than half the threshold from all of them.
        held, self.deciding = np.zeros(len(items)), self.best.copy()
        for t in sorted(lists, key=lambda t: (-len(lists[t]), t)):
            more = held.copy()
            for k, x in lists[t]:
                more[k] += x
            if more.max() <= threshold / 2:
                held, self.deciding[t] = more, 0
        self.spare = float(held.max())

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score reaches the threshold."""
        need = self.threshold - 1e-9
        cursors = [[self.docs[t][0], t, 0] for t in terms if t in self.docs]  # item, term, place
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.best[c[1]]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            tops, until = 0.0, len(self.items)
            for c in cursors[: pivot + 1]:
                docs, block = self.docs[c[1]], c[2] // BLOCK
                while (block + 1) * BLOCK < len(docs) and docs[(block + 1) * BLOCK - 1] < item:
                    block += 1
                tops += self.tops[c[1]][block]
                if (block + 1) * BLOCK < len(docs):
                    until = min(until, docs[(block + 1) * BLOCK])
            if tops >= need:
                if cursors[0][0] == item:
                    score = sum(self.weights[c[1]][c[2]] for c in cursors[: pivot + 1])
                    if score >= need:
                        found.append((item, score))
                    target, move = item + 1, range(pivot + 1)
                else:
                    target, move = item, range(pivot)
            else:
                if pivot + 1 < len(cursors):
                    until = min(until, cursors[pivot + 1][0])
                target, move = max(until, item + 1), range(pivot + 1)
            for k in move:
                c = cursors[k]
                docs = self.docs[c[1]]
                while c[2] < len(docs) and docs[c[2]] < target:
                    step = (c[2] // BLOCK + 1) * BLOCK
                    c[2] = step if step < len(docs) and docs[step - 1] < target else c[2] + 1
                c[0] = docs[c[2]] if c[2] < len(docs) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


class Index:
    """``whole``: (items, mean words, how many items hold each word) of a
    benchmark of which ``items`` are a part; None: they are all of it."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, overlap: float, run: int, k1: float = 1.2, b: float = 0.75, per_block: int = 8, whole: tuple[int, float, dict[int, int]] | None = None):
        self.threshold, self.overlap, self.run = threshold, overlap, run
        found = []
        for item_id, text in sorted(items):
            h = _hashes(text)
            if len(h):
                q, a = split_item(text)
                found.append(Item(item_id, h, _runs(_hashes(q), run), _runs(_hashes(a), run)))
        n = len(found)
        mean = sum(len(i.words) for i in found) / max(n, 1)
        counts = [np.unique(i.words, return_counts=True) for i in found]
        self.terms, df = np.unique(np.concatenate([c[0] for c in counts]) if n else np.zeros(0, np.uint64), return_counts=True)
        if whole is not None:
            mean, df = whole[1], np.array([whole[2][t] for t in self.terms.tolist()], float)
        idf = np.log(1 + ((n if whole is None else whole[0]) - df + 0.5) / (df + 0.5))
        weighed = []
        for item, (words, tf) in zip(found, counts, strict=True):
            at = np.searchsorted(self.terms, words)
            w = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(item.words) / mean))
            weighed.append((item, at, w / w.sum()))
        weighed.sort(key=lambda x: (len(x[0].words), x[0].item_id))
        self.blocks = []
        for _, alike in groupby(weighed, key=lambda x: passage_words(len(x[0].words))):
            alike = list(alike)
            self.blocks += [Block(alike[i : i + per_block], len(self.terms), threshold) for i in range(0, len(alike), per_block)]
        # Whether a term can be among the sorted terms, by its top bits.
        self.bits = max(1, int(math.log2(len(self.terms) + 1)) + 3)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.terms >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def locate(self, h: np.ndarray) -> np.ndarray:
        """Term numbers; -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        if len(self.terms):
            some = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.terms, h[some]), len(self.terms) - 1)
            hit = self.terms[k] == h[some]
            out[some[hit]] = k[hit]
        return out

    def verify(self, item: Item, h: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's runs of words in a passage."""
        out = []
        for text in (item.question, item.answer):
            # Parts shorter than a run are one run of their own length.
            lengths = {min(self.run, len(item.words))} if len(text) > 1 else range(1, self.run + 1)
            have = np.unique(np.concatenate([chain(h, n) for n in lengths]))
            out.append(float(np.isin(text, have).mean()) if len(text) else 1.0)
        return out[0], out[1]

    def matches(self, column: pa.Array):
        """For each text: {item id: (score, question share, answer share)}."""
        need = self.threshold - 1e-9
        for i, j, data, offs in text_chunks(column):
            h, doc, _ = words_of(data, offs, MARKS)
            term = self.locate(h)
            first = np.searchsorted(doc, np.arange(j - i + 1))
            out: list[dict] = [{} for _ in range(j - i)]
            at_all = np.flatnonzero(term >= 0)
            hits = term[at_all]
            for block in self.blocks:
                size, stride = block.window, block.window // 2
                sums = np.zeros(len(h) + 1)
                sums[at_all + 1] = block.deciding[hits]
                np.cumsum(sums, out=sums)
                count = np.maximum(np.ceil((np.diff(first) - size) / stride), 0).astype(np.int64) + 1
                owner = np.repeat(np.arange(j - i), count)
                at = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * stride
                end = np.minimum(at + size, first[owner + 1])
                for k in np.flatnonzero(sums[end] - sums[at] >= need - block.spare - 1e-9).tolist():
                    a, z = at[k], end[k]
                    terms = np.unique(term[a:z])
                    terms = terms[terms >= 0]
                    if block.deciding[terms].sum() < need - block.spare - 1e-9 or block.best[terms].sum() < need:
                        continue
                    for n, score in block.search(terms.tolist()):
                        item = block.items[n]
                        q, ans = self.verify(item, h[a:z])
                        if q >= self.overlap and ans >= self.overlap:
                            old = out[owner[k]].get(item.item_id)
                            if old is None or (score, q, ans) > old:
                                out[owner[k]][item.item_id] = (score, q, ans)
            yield from out


def _words_of_items(batches):
    """Item texts -> (h, words): a row for each distinct word of an item, and
    one with its number of words."""
    for b in batches:
        h = [_hashes(t) for t in b.column(0).to_pylist()]
        each = [np.unique(x) for x in h]
        cols = np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64), np.array([len(x) for x in h], np.int64)
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), none(len(cols[0]))], ["h", "words"])
        yield pa.RecordBatch.from_arrays([none(len(h)), pa.array(cols[1])], ["h", "words"])


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, most_chars: int, threshold: float, overlap: float, run: int):
    """The benchmark's index, or those of parts of about ``most_chars``."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item_id is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= most_chars:
        yield Index([(r.item_id, r.text) for r in items.toLocalIterator()], threshold, overlap, run)
        return
    n = math.ceil(2 * chars / most_chars)
    words = lambda part: part.select("text").mapInArrow(_words_of_items, "h long, words long")
    counts = stage_table(words(items).groupBy("h").agg(F.count("*").alias("df"), F.count_if(F.col("words") > 0).alias("items"), F.sum("words").alias("words")), "benchmark")
    size = counts.where("h is null").first()
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        own = words(part).where("h is not null").select("h").distinct().join(counts, "h")
        df = {r.h % 2**64: r.df for r in own.select("h", "df").toLocalIterator()}
        yield Index([(r.item_id, r.text) for r in part.toLocalIterator()], threshold, overlap, run, whole=(size["items"], size["words"] / max(size["items"], 1), df))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.5,
    overlap: float = 0.5,
    run: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_chars: int = 16_000_000,
) -> DataFrame:
    """Documents that hold a benchmark item: id_col, item_id long, score,
    question_overlap, answer_overlap (double, of the best passage).

    A passage is a window of ``passage_words`` words, half of which the next one
    shares, so every item fits into one whole. A passage is retrieved at ``threshold`` of the item's own BM25 score, and counts if
    it holds ``overlap`` of the runs of ``run`` words of question and answer.

    Null or empty texts match nothing; items without words are skipped; null
    item ids too. Null document ids are reported as null. Repeated rows are
    repeated. Benchmarks of more than ``most_chars`` are searched in parts, with
    the same results. Other columns, whatever their names, are ignored. Empty
    tables: no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = None
    for part in _indexes(benchmark, item_col, item_text_col, most_chars, threshold, overlap, run):
        index = docs.sparkSession.sparkContext.broadcast(part)

        def found(batches, index=index):
            for b in batches:
                rows = [(k, item, *x) for k, m in enumerate(index.value.matches(b.column(1))) for item, x in sorted(m.items())]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64())] + [pa.array(c, pa.float64()) for c in cols[2:]],
                    ["id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        part = source.mapInArrow(found, f"id {kind}, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, overlap: float = 0.5, run: int = 3, most_chars: int = 16_000_000) -> DataFrame:
    """``docs`` with all columns, less the rows that ``leaks`` would report.
    Rows with null or empty texts stay, and those without an id are judged like
    others. Repeated rows go or stay together. Empty tables: all rows stay."""
    at = docs.columns.index(text_col)
    for part in _indexes(benchmark, item_col, item_text_col, most_chars, threshold, overlap, run):
        index = docs.sparkSession.sparkContext.broadcast(part)

        def clean(batches, index=index):
            for b in batches:
                yield b.filter(pa.array([not m for m in index.value.matches(b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
