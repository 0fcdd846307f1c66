"""Hierarchical multi-length packing (operator 1).

Documents are routed to context-size tiers, each tier is packed in windows of its own size, gaps of long windows are filled
from shorter tiers, and the windows of a tier are dealt to step groups of equal token counts and balanced attention cost.

Packing works within each input partition, on lengths only, over blocks of ``block_tokens`` tokens; what doesn't fill a window
is carried to the next block, and the last remainder of a partition is cut into windows whose lengths are powers of two, so
no padding is left.  There is no shuffle: the plan is a scan and one Arrow map, its memory is one block, a lost task is redone
alone, and no document or source can overload a task since a task is an input split.

With ``by``, a sequence holds documents of one value of that column only (a language, say): each value has windows and a last
remainder of its own, and the block is that of all values together.

Edge cases: a null or empty text is the end-of-document id alone; a null doc_id is kept as null; repeated rows are packed once
each; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, ship, slices
from .tokens import encoder, vocabulary

#: Bytes of text that are split at once, and of the worker's cache: less than other token operators take, since this one follows
#: stages whose shuffles have filled the executors' memory.
SLICE, CACHE = 2_500_000, 30_000_000
TIERS = (1024, 512, 256, 128)
#: Bits of a sequence or step number that count within a partition.
LOCAL_BITS = 36


def pack_lengths(tails: list[tuple[int, int, int]], lengths: Sequence[int], tiers: Sequence[int] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Pack documents of the given lengths, and tails (length, document, start) left by an earlier call, into windows.

    Returns windows (size, [(document, start, length), ...]), each exactly full, and the tails that were not placed (none if
    ``last``).  Documents are numbered from 0 in ``lengths``; the numbers in ``tails`` are the caller's own.
    """
    tiers = sorted(tiers, reverse=True)
    top, windows = tiers[0], []
    rest = sorted(tails)
    for doc, n in enumerate(lengths):
        full = n - n % top
        windows += [(top, [(doc, at, top)]) for at in range(0, full, top)]
        if n > full:
            rest.append((n - full, doc, full))
    rest.sort()
    for tier in tiers:
        lowest = tier // 2 if tier != tiers[-1] else 0
        while rest and rest[-1][0] > lowest:
            n, doc, start = rest.pop()
            held, gap = [(doc, start, n)], tier - n
            while gap and rest:
                at = bisect_right(rest, (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    n, doc, start = rest.pop(at)
                else:  # nothing fits whole: cut the shortest one
                    n, doc, start = rest.pop(0)
                    insort(rest, (n - gap, doc, start + gap))
                    n = gap
                held.append((doc, start, n))
                gap -= n
            if not gap:
                windows.append((tier, held))
                continue
            # Only the input's very end comes here: all that is left lies in this window.
            if not last:
                return windows, [(n, doc, start) for doc, start, n in held]
            windows += _powers_of_two(held)
    return windows, []


def _powers_of_two(held: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Cut what is left into windows whose sizes are the powers of two that sum to its length."""
    left, out = sum(n for _, _, n in held), []
    queue = list(reversed(held))
    while left:
        size = 1 << (left.bit_length() - 1)
        need, now = size, []
        while need:
            doc, start, n = queue.pop()
            if n > need:
                queue.append((doc, start + need, n - need))
                n = need
            now.append((doc, start, n))
            need -= n
        out.append((size, now))
        left -= size
    return out


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """A step group for each window: windows of one size, as many tokens in each group as in any other (but for one window),
    dealt in snake order of their attention cost (the sum of squared piece lengths)."""
    out, base, by = [0] * len(windows), 0, {}
    for i, (size, _) in enumerate(windows):
        by.setdefault(size, []).append(i)
    for size, members in sorted(by.items(), reverse=True):
        groups = max(1, round(len(members) * size / step_tokens))
        members.sort(key=lambda i: (-sum(n * n for _, _, n in windows[i][1]), i))
        for k, i in enumerate(members):
            lap, at = divmod(k, groups)
            out[i] = base + (groups - 1 - at if lap % 2 else at)
        base += groups
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str | None = None, end_id: int = 0, tiers: Sequence[int] = TIERS, step_tokens: int = 32_768, block_tokens: int = 1_000_000, with_ids: bool = False, by: str | None = None) -> DataFrame:
    """Pieces of all documents in packed sequences of at most ``max(tiers)`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the sequence's length: all
    sequences are full), step_group, if ``with_ids``, the piece's token ids and, with ``by``, the value of that column that all of the
    sequence's documents have (null is a value).
    """
    source = id_and_text(docs, id_col, text_col)
    if by is not None:
        ship(docs.sparkSession)
        source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(by).cast("string").alias("by"))
    kind = source.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if by is not None:
        fields.append(T.StructField(by, T.StringType()))
    sent = docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    return source.mapInArrow(_packer(sent, end_id, tuple(tiers), step_tokens, block_tokens, with_ids, by), T.StructType(fields))


@dataclass
class _Open:
    """Documents of one value that are not packed yet: the block's own, and those carried from earlier blocks."""

    names: list = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)
    carried: list[tuple[int, int, int]] = field(default_factory=list)
    carry_names: list = field(default_factory=list)
    carry_texts: list[np.ndarray] = field(default_factory=list)
    held: int = 0


def _packer(sent, end_id: int, tiers: tuple[int, ...], step_tokens: int, block_tokens: int, with_ids: bool, by: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent.value, CACHE)
        base = TaskContext.get().partitionId() << LOCAL_BITS
        sequences = steps = 0
        opened: dict[str | None, _Open] = {}
        kind = None

        def flush(value: str | None, last: bool) -> pa.RecordBatch | None:
            nonlocal sequences, steps
            now = opened[value]
            # Carried documents get numbers after the block's own.
            n = len(now.texts)
            windows, left = pack_lengths([(size, n + doc, start) for size, doc, start in now.carried], [len(x) for x in now.texts], tiers, last)
            all_names, all_texts = now.names + now.carry_names, now.texts + now.carry_texts
            groups = step_groups(windows, step_tokens)
            who, cols, ids = [], [], []
            for (size, pieces), group in zip(windows, groups, strict=True):
                at = 0
                for doc, start, length in pieces:
                    x = all_texts[doc]
                    part = x[start : start + length]
                    who.append(all_names[doc])
                    cols.append((start, length, zlib.crc32(part), len(x), base + sequences, at, size, base + steps + group))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    at += length
                sequences += 1
            steps += max(groups, default=-1) + 1
            keep = sorted({doc for _, doc, _ in left})
            opened[value] = _Open(carried=[(size, keep.index(doc), start) for size, doc, start in left], carry_names=[all_names[d] for d in keep], carry_texts=[all_texts[d] for d in keep])
            if not who:
                return None
            made = np.array(cols, np.int64).T
            arrays = [pa.array(who, kind), *(pa.array(c) for c in made)]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(np.concatenate(ids))))
            keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids"][: len(arrays)]
            if by is not None:
                arrays.append(pa.array([value] * len(who), pa.string()))
                keys.append(by)
            return pa.RecordBatch.from_arrays(arrays, keys)

        for batch in batches:
            kind = batch.column(0).type
            for a, b in slices(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                ids, counts = coder.encode(part.column(1).to_pylist())
                edges = np.concatenate([[0], np.cumsum(counts)])
                tail = np.array([end_id], np.uint32)
                values = part.column(2).to_pylist() if by is not None else [None] * len(counts)
                for name, value, i, j in zip(part.column(0).to_pylist(), values, edges[:-1], edges[1:], strict=True):
                    now = opened.setdefault(value, _Open())
                    now.names.append(name)
                    now.texts.append(np.concatenate([ids[i:j], tail]))
                    now.held += int(j - i) + 1
                while sum(x.held for x in opened.values()) >= block_tokens:
                    if (out := flush(max(opened, key=lambda v: opened[v].held), False)) is not None:
                        yield out
        for value in [*opened]:
            if (out := flush(value, True)) is not None:
                yield out

    return run


def padding(pieces: DataFrame) -> DataFrame:
    """Tokens, sequences and padding of a packing (a sequence is padded to 1024 unless its length is a power of two)."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    full = (F.col("used").bitwiseAND(F.col("used") - 1)) == 0
    return used.agg(F.sum("used").alias("tokens"), F.count("*").alias("sequences"), F.sum(F.when(full, 0).otherwise(1024 - F.col("used"))).alias("padding"))
