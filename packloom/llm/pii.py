"""Personal data by bootstrapped contextual extraction.

Four base patterns find seed entities. Around and in each seed lie lexical
patterns: the two words before it; the word before and the word after; the
label before it (a word and its separators, as in ``tel:``); its shape (runs
of letters, digits counted and not, separators); the shape with the word before; the
shape of its last piece. The same patterns are taken of every other
identifier-like run of text, which gives a graph of patterns and instances.
Spark scores it iteratively: a pattern is as good as the share of its distinct
instances that are known to be of one kind, an instance as good as its
patterns together. Patterns above a threshold, with enough distinct instances
behind them, then name identifiers that no base pattern matches. Instances are
distinct values, so copies of a text add no evidence. What a base pattern
matches but its check rejects (a number that fails Luhn) is an instance of no
kind, so shapes that such numbers have are not believed.

Texts are read once. What leaves them are spans and hashes of the patterns,
which is little; the graph's aggregations combine map-side, and its joins deal
out the instances of one pattern, so a pattern that a third of all instances
share costs no more than others.

Definitions that bound what is looked at, at every size of text alike: a
candidate has 5 to 64 characters; the words around it are cut at 96 characters
from it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive where that changes no match, so
# long runs cost linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]+")
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"([^\W\d_]+)|[0-9]+")
_COUNT = re.compile(r"9[0-9]+")
#: A word and the separators that make it a label of what follows.
_LABEL = re.compile(r"([^\W\d_]+)(\s*[:=]\s*[\"'(\[<]?)$")
#: Digits and their marks over single spaces, as numbers are written in pieces.
_PIECES = re.compile(r"[+(]?[0-9][0-9().+-]*(?: [0-9().+-]*[0-9][0-9().+-]*)+")
_STRIP = ".,;:!?()[]{}\"'<>|*%$&#~`=/\\"
_WINDOW = 96
_LANES = 16
_LONGEST = 64


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start: leftmost
    and non-overlapping for each kind; a match that fails its check is gone,
    and the search goes on behind it."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL_END.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or "0") < 256 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shape_of(token: str) -> str:
    """Letters as ``a``, runs of digits as ``9`` and their number, the rest as it is."""
    return _RUN.sub(lambda m: "a" if m[1] else f"9{len(m[0])}", token)


def _contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns of a span."""
    token, lead = text[start:end], text[max(0, start - _WINDOW) : start]
    left = [w for w in (x.strip(_STRIP).lower() for x in lead.split()[-3:]) if w][-2:]
    right = [w for w in (x.strip(_STRIP).lower() for x in text[end : end + _WINDOW].split()[:2]) if w][:1]
    shape = shape_of(token)
    found = [f"s {shape}", f"g {_COUNT.sub('9', shape)}"]
    if left:
        found.append(f"c {left[-1]} {shape}")
    if len(left) == 2:
        found.append(f"l {left[0]} {left[1]}")
    if left and right:
        found.append(f"m {left[-1]} {right[0]}")
    if label := _LABEL.search(lead):
        found.append(f"b {label[1].lower()}{''.join(label[2].split())}")
    if (last := token.rsplit(None, 1)[-1]) != token:
        found.append(f"e {shape_of(last)}")
    return [_hash(x) for x in found]


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def identifier_like(token: str) -> bool:
    """Whether a token could be an identifier: four digits or more, digits
    among letters, or an at sign; 5 to 64 characters."""
    digits = sum("0" <= c <= "9" for c in token)
    return 5 <= len(token) <= _LONGEST and (digits >= 4 or digits >= 1 and any(c.isalpha() for c in token) or "@" in token[1:-1])


def _candidates(text: str, taken: list[tuple[int, int, int]]):
    """Identifier-like tokens, and numbers in pieces, that no base span touches."""
    spans = sorted((a, z) for _, a, z in taken)
    ends = [z for _, z in spans]
    free = lambda a, z: (k := bisect_right(ends, a)) == len(spans) or spans[k][0] >= z
    pieces = []
    for m in _PIECES.finditer(text):
        if len(m[0]) <= _LONGEST and sum("0" <= c <= "9" for c in m[0]) >= 7 and free(*m.span()):
            pieces.append(m.span())
            yield *m.span(), m[0]
    behind, piece = 0, 0
    for m in _HIT.finditer(text):
        if m.start() < behind:
            continue
        before, after = text[max(0, m.start() - _LONGEST) : m.start()], text[m.end() : m.end() + _LONGEST]
        cut = max((s.end() for s in _SPACE.finditer(before)), default=0 if len(before) < _LONGEST or m.start() == len(before) else None)
        stop = _SPACE.search(after)
        if cut is None or stop is None and len(after) == _LONGEST:
            behind = m.end()
            continue
        start, end = m.start() - len(before) + cut, m.end() + (stop.start() if stop else len(after))
        behind = end
        token = text[start:end]
        start += len(token) - len(token.lstrip(_STRIP))
        token = token.strip(_STRIP)
        end = start + len(token)
        while piece < len(pieces) and pieces[piece][1] <= start:
            piece += 1
        inside = piece < len(pieces) and pieces[piece][0] < end
        if not inside and identifier_like(token) and free(start, end):
            yield start, end, token


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _read(at: int, hide: tuple[int, int] | None):
    """Rows -> the same, with row number, base spans and mentions in context."""

    def run(batches):
        n = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = b.column(at).fill_null("").to_pylist()
            spans, mentions = [], []
            for text in texts:
                found, seen = [], []
                if _HIT.search(text):
                    found = base_spans(text)
                    taken, found = found, []
                    for k, a, z in taken:
                        instance = _hash(f"{k} {text[a:z]}")
                        hidden = hide is not None and instance % hide[0] == hide[1]
                        if not hidden:
                            found.append((k, a, z))
                        seen.append({"kind": -1 if hidden else k, "start": a, "end": z, "instance": instance, "patterns": _contexts(text, a, z)})
                    for a, z, token in _candidates(text, taken):
                        seen.append({"kind": -1, "start": a, "end": z, "instance": _hash(f"- {token}"), "patterns": _contexts(text, a, z)})
                spans.append([{"kind": k, "start": a, "end": z} for k, a, z in found])
                mentions.append(seen)
            cols = [pa.array(np.arange(n, n + b.num_rows)), pa.array(spans, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))]
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "row", "spans", "mentions"])

    return run


def graph_scores(mentions: DataFrame, rounds: int = 10, support: float = 3.0, pattern_score: float = 0.6, instance_score: float = 0.7) -> DataFrame:
    """From mentions (kind, instance, pattern; kind -1 is unknown) the unknown
    instances that good patterns name: (instance, kind, score). Rounds end when
    as many instances are named as in the round before."""
    edges = stage_table(mentions.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "graph")
    unknown = edges.where("kind < 0").select("pattern", "instance", F.pmod(F.xxhash64("instance"), F.lit(_LANES)).cast("int").alias("lane"))
    belief = None
    for _ in range(rounds):
        weight = lambda k, own: F.sum(F.when(F.col("kind") == k, own).otherwise(0.0)).alias(f"s{k}")
        known = edges if belief is None else edges.join(belief.withColumnRenamed("kind", "thought"), "instance", "left").select("pattern", "instance", F.when(F.col("kind") < 0, F.coalesce("thought", "kind")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") < 0, F.coalesce("score", F.lit(0.0))).otherwise(1.0).alias("w"))
        if belief is None:
            known = known.withColumn("w", (F.col("kind") >= 0).cast("double"))
        sums = known.groupBy("pattern").agg(F.count("*").alias("n"), *(weight(k, F.col("w")) for k in range(len(KINDS))))
        best = F.greatest(*(f"s{k}" for k in range(len(KINDS))))
        which = F.coalesce(*(F.when(F.col(f"s{k}") == F.col("best"), F.lit(k)) for k in range(len(KINDS))))
        patterns = sums.withColumn("best", best).where(F.col("best") >= support).select("pattern", which.alias("kind"), (F.col("best") / (F.col("n") + 0.5)).alias("score")).where(F.col("score") >= pattern_score)
        # A common pattern's instances are dealt to several tasks.
        patterns = patterns.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(_LANES - 1))))
        named = unknown.join(patterns, ["pattern", "lane"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score"))
        new = named.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m")).select("instance", (-F.col("m.k")).alias("kind"), F.col("m.score").alias("score"))
        new = stage_table(new, "belief")
        size = new.count()
        if belief is not None and size == last:
            belief = new
            break
        belief, last = new, size
        if not size:
            break
    return belief.where(F.col("score") >= instance_score)


def pii_spans(docs: DataFrame, columns: list[str], text_col: str = "text", hide: tuple[int, int] | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: ``columns`` as c0, c1, ..., base
    array<struct<kind, start, end>> and spans, the same with what the contexts
    add; code points, end exclusive, sorted by kind as in ``KINDS``, then start.
    ``hide`` (modulus, remainder) takes the seeds whose hash has that remainder
    for unknown ones, to measure how many come back; ``options`` are those of
    ``graph_scores``.

    Null texts are empty and have no spans. A value found by contexts never
    overlaps a base span. Ties between kinds go to the one listed first.
    Repeated rows are repeated, but lend a pattern no support. Empty input: no
    rows.
    """
    names = [f"c{k}" for k in range(len(columns))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col(text_col).alias("body"))
    span = "array<struct<kind: int, start: bigint, end: bigint>>"
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    read = source.mapInArrow(_read(len(names), hide), f"{kinds}, row long, spans {span}, mentions array<struct<kind: int, start: bigint, end: bigint, instance: bigint, patterns: array<bigint>>>")
    read = stage_table(read.drop("body"), "mentions")
    each = read.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m"))
    graph = each.select("m.kind", "m.instance", F.explode("m.patterns").alias("pattern"))
    found = graph_scores(graph, **options)
    more = each.where("m.kind < 0").select("row", "m.start", "m.end", "m.instance").join(found.select("instance", "kind"), "instance")
    more = more.groupBy("row").agg(F.collect_list(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")).alias("more"))
    asks = F.exists("mentions", lambda m: m["kind"] < 0)
    plain = read.where(~asks).select(*names, F.col("spans").alias("base"), F.array_sort("spans").alias("spans"))
    rest = read.where(asks).join(more, "row", "left")
    both = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(span))))
    return plain.union(rest.select(*names, F.col("spans").alias("base"), both.alias("spans")))


def span_text(spans):
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id_col, n_email, n_ip, n_card, n_phone (long, base spans),
    base_sha256 of the base spans' text, spans (all spans' text)."""
    found = pii_spans(docs, [id_col], text_col, **options)
    count = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("c0").alias(id_col), *count, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _count(kind: int):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def masked(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in angle
    brackets; overlapping spans become one, named by the first. Null texts
    stay null. All columns and rows stay."""
    columns = docs.columns
    at = columns.index(text_col)
    found = pii_spans(docs, columns, text_col, **options)

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True):
                if text is not None and spans:
                    parts, behind = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= behind:
                            parts += [text[behind : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                        behind = max(behind, s["end"])
                    text = "".join(parts) + text[behind:]
                out.append(text)
            cols = [pa.array(out, pa.string()) if k == at else b.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, columns)

    return found.drop("base").mapInArrow(run, docs.schema)
