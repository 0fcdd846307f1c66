"""Language-model scoring with a log-frequency Bloom filter (operator 9).

Tokens are lower-cased words and an end token.  Each slice of texts counts its unigrams and bigrams, by 64-bit hash, and sends the
distinct ones to hash buckets: those of training texts with their counts, those of held-out texts as questions only.  A bucket adds
the counts up and builds its segment of the filter, in which an n-gram that occurs c times lies once for each level
1 .. 1 + floor(log2 c).  The segment is probed, level after level until one is missing, for every n-gram that any slice asked
for, and the levels (and exact counts of tokens) go back to the slices, where P(w | v) interpolates the bigram estimate with
the smoothed unigram one.

Segments are sized by the entries counted for them, so that their load stays below ``load`` (there an absent entry's probes pass
with probability of about 0.05): no n-gram is left out at any size of corpus.  ``filter_bits`` is only the least size of all segments
together.  The filter grows with the corpus, so it isn't broadcast: its segments are probed where they are built, and questions
travel to them once, in the same shuffle as the counts.  The driver gets one row of sums.

Texts are scanned twice, for the questions and for the scores, in the same slices: what isn't read straight from a table is written
first.  Buckets grow with the input's partitions up to 2**18.  An n-gram costs at most one entry a slice in its bucket, and
slices grow with the buckets, so that a bucket gets some entries of each slice.

Edge cases: a null text is an empty one (an end token only); null ids are not held out and are learned from; repeated rows
are learned from and scored once each; texts may be of any length; without training texts N and V are 0 and every token is unknown; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import mix, release, slices, utf8, written, Words

U = np.uint64
_PHI, _PSI = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
END = np.array([0x5851F42D4C957F2D], U)  # the end token's hash, also what stands before a text's first word
LEVELS, PROBES = 40, 3
LAMBDA = 0.6
LOW48 = U((1 << 48) - 1)
#: Tokens in a slice where there are few buckets, and at most (but for a single longer text).
SLICE, MOST = 800_000, 4_000_000
UNIGRAM, BIGRAM = 0, 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, one after another, each text closed by the end token, and how many each text has."""
    words = Words(texts, lower=True)
    n = words.count + 1
    out = np.empty(int(n.sum()), U)
    ends = np.cumsum(n) - 1
    out[ends] = END
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = words.hashes()
    return out, n


def bigrams(t: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it (the end token before a text's first)."""
    before = np.concatenate([END, t[:-1]])
    return mix(before * _PHI + mix(t ^ _PSI))


def counted(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the sum of each one's weights, and the place of every x among them."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(x) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    where = np.empty(len(x), np.int64)
    where[order] = np.cumsum(new) - 1
    return ordered[at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64), where


def _six(x: np.ndarray) -> bytes:
    """The lower 48 bits of each hash."""
    return np.ascontiguousarray(x.astype("<u8")[:, None].view(np.uint8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(U)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64))


def places(key: np.ndarray, level: int, kind: int, size: int) -> list[np.ndarray]:
    """Where the probes of an entry fall in a segment of ``size`` bits."""
    a = mix(key * _PSI + U((level * 2 + kind) * int(_PHI) % (1 << 64)))
    step = (a >> U(32)) | U(1)
    return [(((a + U(i) * step) & U(0xFFFFFFFF)) * U(size) >> U(32)).astype(np.int64) for i in range(PROBES)]


def read(segment: bytes, low: np.ndarray, kind: int) -> np.ndarray:
    """The level at which a segment holds each n-gram (by the lower 48 bits of its hash), 0 if it doesn't."""
    bits, level, at = np.frombuffer(segment, np.uint8), np.zeros(len(low), np.uint8), np.arange(len(low))
    for step in range(1, LEVELS + 1):
        held = np.ones(len(at), bool)
        for p in places(low, step, kind, 8 * len(bits)):
            held &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        at, low = at[held], low[held]
        if not len(at):
            break
        level[at] = step
    return level


def stands_for(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 0 if the n-gram isn't held."""
    return np.where(level > 0, np.floor(1.5 * 2.0 ** (level.astype(np.int64) - 1)), 0.0)


def segment_of(keys: np.ndarray, counts: np.ndarray, kind: int, least: int, load: float) -> bytes:
    """The bits that hold these n-grams at all levels of their counts."""
    keys, level = keys[counts > 0], level_of(counts[counts > 0])
    size = max(least, -(-int(np.ceil(int(level.sum()) * PROBES / load)) // 8) * 8)
    bits = np.zeros(size, np.uint8)
    for step in range(1, int(level.max(initial=0)) + 1):
        for place in places(keys[level >= step], step, kind, size):
            bits[place] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Model:
    """Sums over the corpus; the segments stay in a table (bucket, one, two: of unigrams and of bigrams)."""

    def __init__(self, segments: DataFrame, buckets: int, total: int, distinct: int):
        self.segments, self.shift = segments, U(64 - (buckets.bit_length() - 1))
        self.total, self.distinct = total, distinct

    def counts(self, key: np.ndarray, kind: int) -> np.ndarray:
        """The counts of some n-grams as the filter holds them, looked up from the driver, a bucket at a time."""
        bucket, out = (key >> self.shift).astype(np.int64), np.zeros(len(key))
        for r in self.segments.select("bucket", ("one", "two")[kind]).toLocalIterator():
            mine = np.flatnonzero(bucket == r[0])
            out[mine] = stands_for(read(r[1], key[mine] & LOW48, kind))
        return out


def log10(one: np.ndarray, two: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 P of each token after the one before it, by the counts of the tokens and of the bigrams that end in them."""
    before = np.concatenate([one[-1:], one[:-1]])
    two = np.minimum(two, before)
    uni = (one + 1) / (total + distinct + 1)
    return np.log10(np.where(before > 0, LAMBDA * two / np.maximum(before, 1) + (1 - LAMBDA) * uni, uni))


def _buckets(docs: DataFrame) -> int:
    """How many hash buckets: a power of two, at least four for each input partition, between 2**7 and 2**18."""
    return 1 << min(18, max(7, (4 * max(1, docs.rdd.getNumPartitions()) - 1).bit_length()))


def _cut(values: bytes, width: int, edges: np.ndarray) -> pa.Array:
    """Binary values of some bytes of each entry, as the entries lie between edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype("<i4").tobytes()), pa.py_buffer(values)])


#: What a slice sends to a bucket: tokens and bigrams (lower 48 bits of their hashes) with their counts in training texts.
ASKS = "slice long, bucket int, tokens binary, token_counts binary, pairs binary, pair_counts binary"
#: What a bucket answers each slice, in the order of its questions; and for slice -1 its sums and segments.
ANSWERS = "slice long, bucket int, counts binary, levels binary, pair_levels binary, total long, distinct long, one binary, two binary"


def _answer(asks: DataFrame, least: int, load: float) -> DataFrame:
    schema = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("counts", "levels", "pair_levels")), ("total", pa.int64()), ("distinct", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        n, bucket = group.num_rows, group["bucket"][0].as_py()

        def merged(keys: str, counts: str, kind: int) -> tuple:
            rows = group[keys].to_pylist()
            edges = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)]) // 6
            key, total, where = counted(_from_six(b"".join(rows)), np.frombuffer(b"".join(group[counts].to_pylist()), "<u4").astype(np.int64))
            segment = segment_of(key, total, kind, least, load)
            return total, where, edges, segment, read(segment, key, kind)[where]

        exact, where, one, segment, levels = merged("tokens", "token_counts", UNIGRAM)
        _, _, two, other, pair_levels = merged("pairs", "pair_counts", BIGRAM)
        none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())
        answers = pa.Table.from_arrays([group["slice"].combine_chunks(), pa.array(np.full(n, bucket, np.int32)), _cut(exact[where].astype("<i8").tobytes(), 8, one), _cut(levels.tobytes(), 1, one), _cut(pair_levels.tobytes(), 1, two), *none], schema=schema)
        sums = pa.table({"slice": [-1], "bucket": [bucket], "counts": [None], "levels": [None], "pair_levels": [None], "total": [int(exact.sum())], "distinct": [int((exact > 0).sum())], "one": [segment], "two": [other]}, schema=schema)
        return pa.concat_tables([answers, sums])

    return asks.groupBy("bucket").applyInArrow(run, ANSWERS)


#: What a slice keeps to itself: ids, lengths, distinct tokens, and which token stands where.
WHOLE = ("slice", "doc_ids", "held", "lengths", "distinct", "codes")


def _codes(x: np.ndarray, width: int) -> bytes:
    """The lower bytes of each number."""
    return np.ascontiguousarray(x.astype("<u4")[:, None].view(np.uint8)[:, :width]).tobytes()


def _from_codes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u4").ravel().astype(np.int64)


def _width(distinct: int) -> int:
    return 2 if distinct <= 1 << 16 else 3 if distinct <= 1 << 24 else 4


def _scan(source: DataFrame, buckets: int, questions: bool) -> DataFrame:
    """The slices of (doc_id, held_out, text): their questions to each bucket, or what each keeps to itself."""
    shift, limit = U(64 - (buckets.bit_length() - 1)), min(MOST, SLICE * max(1, buckets >> 14))
    kind = source.schema["doc_id"].dataType
    own = T.StructType([T.StructField("slice", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), *(T.StructField(c, T.BinaryType()) for c in WHOLE[3:])])
    schema = T._parse_datatype_string(ASKS) if questions else own
    bounds = np.arange(buckets + 1, dtype=U)

    def asked(at: int, t: np.ndarray, learned: np.ndarray) -> pa.RecordBatch:
        distinct, token_counts, _ = counted(t, learned)
        pair, pair_counts, _ = counted(bigrams(t), learned)
        one, two = (np.searchsorted(x >> shift, bounds) for x in (distinct, pair))
        some = pa.array((np.diff(one) > 0) | (np.diff(two) > 0))
        sent = [pa.array(np.full(buckets, at)), pa.array(np.arange(buckets, dtype=np.int32)), _cut(_six(distinct), 6, one), _cut(_codes(token_counts, 4), 4, one), _cut(_six(pair), 6, two), _cut(_codes(pair_counts, 4), 4, two)]
        return pa.RecordBatch.from_arrays(sent, schema.names).filter(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, nth = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth
            t, n = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            flags = [f for x in held for f in x[1]]
            at = part << 32 | nth
            nth += 1
            if questions:
                return asked(at, t, np.repeat(~np.array(flags, bool), n).astype(np.int64))
            distinct, where = np.unique(t, return_inverse=True)
            values = [[at], [[i for x in held for i in x[0]]], [flags], [n.astype("<i8").tobytes()], [distinct.astype("<u8").tobytes()], [_codes(where, _width(len(distinct)))]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.list_(ids), pa.list_(pa.bool_()), *[pa.binary()] * 3), strict=True)], schema.names)

        for batch in batches:
            ids = batch.column(0).type
            for a, b in slices(batch.column(2)):
                rows = batch.slice(a, b - a)
                held.append((rows.column(0).to_pylist(), rows.column(1).to_pylist(), *tokens(utf8(rows.column(2)))))
                if sum(len(x[2]) for x in held) >= limit:
                    yield flush()
                    held.clear()
        if held:
            yield flush()
        release()

    return source.mapInArrow(run, schema)


def _rescannable(df: DataFrame) -> DataFrame:
    """``df`` if it reads a table in place, else a written copy, so that two scans see the same partitions."""
    return written(df, "texts") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def _learn(asks: DataFrame, buckets: int, filter_bits: int, load: float) -> tuple[Model, DataFrame]:
    """The model, and what the buckets answer the slices."""
    least = max(64, filter_bits // 2 // buckets // 8 * 8)
    found = written(_answer(asks, least, load), "ngrams")
    segments = found.where("slice < 0")
    sums = segments.agg(F.sum("total"), F.sum("distinct")).first()
    return Model(segments.select("bucket", "one", "two"), buckets, sums[0] or 0, sums[1] or 0), found.where("slice >= 0").select("slice", "bucket", "counts", "levels", "pair_levels")


def train(texts: DataFrame, *, buckets: int, filter_bits: int = 1 << 28, load: float = 0.45) -> Model:
    """A model of a column ``text``."""
    ship(texts.sparkSession)
    source = texts.select(F.lit(0).alias("doc_id"), F.lit(False).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _learn(_scan(source, buckets, True), buckets, filter_bits, load)[0]


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 28, load: float = 0.45) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    ship(docs.sparkSession)
    source = _rescannable(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    buckets = _buckets(source)
    model, found = _learn(_scan(source, buckets, True), buckets, filter_bits, load)
    total, all_distinct = model.total, model.distinct
    whole = _scan(source, buckets, False).select("slice", F.lit(-1).alias("bucket"), *WHOLE[1:], *[F.lit(None).cast("binary").alias(c) for c in ("counts", "levels", "pair_levels")])
    both = whole.unionByName(found, allowMissingColumns=True)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [source.schema["doc_id"].dataType, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]

    def finish(group: pa.Table) -> pa.Table:
        """The scores of one slice's texts."""
        group = group.sort_by("bucket")  # first the slice's own row, then answers in the order of the hashes
        n, distinct = np.frombuffer(group["lengths"][0].as_py(), "<i8"), np.frombuffer(group["distinct"][0].as_py(), "<u8")
        where = _from_codes(group["codes"][0].as_py(), _width(len(distinct)))
        counts, levels, two = (np.frombuffer(b"".join(group[c].to_pylist()[1:]), k) for c, k in (("counts", "<i8"), ("levels", np.uint8), ("pair_levels", np.uint8)))
        _, _, pair = counted(bigrams(distinct[where]), np.zeros(len(where), np.int64))
        text = np.repeat(np.arange(len(n)), n)
        sums = lambda x: np.bincount(text, x, len(n))
        base, known = sums(np.log10(counts + 1.0)[where]), sums((counts > 0)[where])
        logs = sums(log10(stands_for(levels)[where], stands_for(two)[pair], total, all_distinct))
        cols = [group["doc_ids"].combine_chunks()[0].values, group["held"].combine_chunks()[0].values, pa.array(n), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(n), total)), pa.array(base - n * np.log10(total + all_distinct + 1)), pa.array(logs)]
        return pa.table(cols, names=names)

    return both.groupBy("slice").applyInArrow(finish, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
