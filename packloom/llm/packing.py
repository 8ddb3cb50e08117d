"""Best-fit packing of token sequences by the sum-of-squares rule.

Tokenising happens once, map-side, and only piece lengths and checksums leave
it. Pieces are dealt out to shards of bounded size; a shard is packed in
decreasing order of length, each piece going where the sum over residual gaps
of the squared number of open bins with that gap becomes smallest. State per
shard: one count and one stack of open bins for each gap, so the placement of
a piece costs the capacity, whatever the number of bins. Sequences that are
still open at the end are filled anew by best fit, if that saves any.
"""

from __future__ import annotations

import array
import bisect
import json
import math
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: The pre-tokeniser of byte-level BPE vocabularies of this family (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself
    where it is one, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _core_bpe(path: str):
    """The same vocabulary in tiktoken, much faster on short parts; None if
    the file isn't plain byte-level BPE whose ids follow the merges."""
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in merges]
    if any(a >= b for a, b in zip([255, *ids], ids)) or len(vocab) != len(set(merges)) + 256:
        return None
    chars = _byte_of_char()
    ranks = {bytes(chars[c] for c in k): v for k, v in vocab.items()}
    return tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Parts(dict):
    """Ids of the parts met so far, each with the space before it."""

    def __init__(self, encode, encode_piece):
        self.encode, self.encode_piece = encode, encode_piece

    def __missing__(self, part: str) -> bytes:
        # Letters with a space before them are a single piece to the pre-tokeniser.
        self[part] = ids = self.encode_piece(" " + part) if part.isalpha() else self.encode(" " + part)
        return ids


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the
    ``tokenizers`` library for the file; it remembers what each
    space-separated part encodes to.

    The pre-tokeniser never joins a character with a space after it, so where
    all runs of white space are single spaces or line feeds a text is the
    concatenation of its parts, each but the first with the space before it.
    Other texts are encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        core = _core_bpe(path)
        if core is not None:
            self.whole = lambda t: array.array("I", core.encode_ordinary(t)).tobytes()
            single = core._core_bpe.encode_single_piece
            piece = lambda t: array.array("I", single(t.encode())).tobytes()
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.whole = piece = lambda t: array.array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        self.most = most
        self.parts = _Parts(self.whole, piece)

    def encode(self, text: str) -> bytes:
        words = text.split()
        plain = text.count(" ") + text.count("\n")
        if len(text) != plain + sum(map(len, words)) or plain != len(words) - 1:
            return self.whole(text)
        if len(self.parts) > self.most:
            self.parts.clear()
        head, *rest = text.split(" ")
        return self.whole(head) + b"".join(map(self.parts.__getitem__, rest))


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        encoder = Encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = []
                texts = part.column(1).fill_null("").to_pylist()
                for k, text in enumerate(texts):
                    ids = encoder.encode(text) + end
                    total = len(ids) // 4
                    length = (total - 1) % capacity + 1
                    start = piece = 0
                    while start < total:
                        rows.append((k, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, piece, length = start + length, piece + 1, capacity
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[2:]],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given. Ties go to the
    smallest gap, an open bin before a new one."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; gap 0 is closed and counts nothing
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        gaps = open_bins[s:]
        after = open_bins[: capacity + 1 - s]
        cost = np.where(gaps > 0, 2 * (after - gaps) + 2, never)  # less N(g), more N(g - s)
        if gaps[0] > 0:
            cost[0] = 1 - 2 * gaps[0]
        g = int(np.argmin(cost))
        new = 2 * open_bins[capacity - s] + 1 if s < capacity else 0
        if cost[g] <= new:
            g += s
            b = stacks[g].pop()
            open_bins[g] -= 1
        else:
            g, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            stacks[g - s].append(b)
            open_bins[g - s] += 1
    return bins, offsets


def _refilled(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, capacity: int) -> None:
    """Bins that the rule left with room are emptied and filled anew, longest
    item first into the fullest bin that takes it, if that needs fewer."""
    held = np.bincount(bins, lengths)
    part = np.flatnonzero(held[bins] < capacity)
    names = np.flatnonzero(held < capacity)
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    made, put = 0, []
    for i in part[np.argsort(-lengths[part], kind="stable")].tolist():
        s = int(lengths[i])
        at = bisect.bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, made = capacity, made, made + 1
        put.append((i, b, capacity - free))
        if free > s:
            bisect.insort(room, (free - s, b))
    if made < len(names):
        for i, b, offset in put:
            bins[i], offsets[i] = names[b], offset


def _packed(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        _refilled(lengths, bins, offsets, capacity)
        return pdf.assign(sequence_id=pdf["shard"].astype("int64") * 2**32 + bins, offset=offsets)[["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_rows: int = 65_536,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    A document is its token ids, then ``end_id``. One longer than ``capacity``
    is cut; its first piece takes what is over, all others are full. Returns
    per piece: id_col, piece int, start, length, ids_crc32, sequence_id,
    offset (long). Sequences have no gaps.

    Null and empty texts are the end id alone. Null ids and repeated rows are
    packed as any row. Other columns are ignored. Empty input: no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    pieces = stage_table(source.mapInArrow(_pieces(tokenizer_path, capacity, end_id), f"id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")
    shards = max(1, math.ceil(pieces.count() / shard_rows))
    # Dealt out by row number: shards are even whatever repeats in the input.
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInPandas(_packed(capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
