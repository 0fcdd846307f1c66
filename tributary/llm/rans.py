"""Token-id files coded by a static range asymmetric numeral system (operator 2).

File format: a folder of Parquet files whose rows are segments in ascending doc_id order (shard, then segment).  A segment
holds whole documents: their ids and token counts, and a frame.  A frame has one frequency table that all its blocks share
and blocks of ``BLOCK`` tokens that are coded independently, each by ``LANES`` interleaved states.  A block carries checkpoints (word position
and all states) every ``CHECK_ROWS`` rows, a checksum of its coded words and one of its ids; a decoder starts at any block or
checkpoint, and this one decodes all of them in lockstep with vector operations.

One shuffle (a range partitioning by doc_id) puts documents in order; each range is tokenised, counted and coded where it
lies, so the ids never move.  What the driver gets is one token total for each shard (partition), as many as Spark has tasks.

Edge cases: a null or empty text is the end id alone; null doc_ids come first; rows with equal doc_id are ordered by a hash of
their text and each is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, slices, written
from .tokens import TOKEN_SLICE, encoder, vocabulary

PRECISION = 18
LANES, BLOCK, CHECK_ROWS = 128, 65_536, 256
LOW = np.uint64(1 << 31)
MAGIC = b"RANS0001"
_U = np.uint64
_32 = _U(32)


def normalise(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Integer frequencies that sum to 2**precision; a symbol that occurs gets at least 1."""
    total, size = int(counts.sum()), 1 << precision
    if np.count_nonzero(counts) > size:
        raise ValueError("more symbols than slots: raise the precision")
    freq = np.where(counts > 0, np.maximum(1, counts * size // max(total, 1)), 0).astype(np.int64)
    spare = size - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    if spare > 0:
        freq[order[0]] += spare
    at = 0
    while spare < 0:  # symbols rounded up to 1 took too much: take it back from the most frequent ones
        give = min(-spare, int(freq[order[at]]) // 2)
        freq[order[at]] -= give
        spare += give
        at = (at + 1) % max(1, np.count_nonzero(freq > 1))
    return freq


def _varints(x: np.ndarray) -> bytes:
    out = bytearray()
    for v in x.tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _read_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts) if len(b) else np.zeros(0, np.int64)


def _code(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code the rows of ids (blocks x tokens) in lockstep, backwards.

    Returns words and their mask (blocks x rows x lanes) and the states at each checkpoint (checkpoints x blocks x lanes)."""
    blocks, n = ids.shape
    rows = -(-n // lanes)
    x = np.full((blocks, lanes), LOW)
    words, mask = np.zeros((blocks, rows, lanes), np.uint32), np.zeros((blocks, rows, lanes), bool)
    checks = np.zeros((-(-rows // every), blocks, lanes), _U)
    cap = _U(((1 << 31) >> PRECISION) << 32)
    for row in range(rows - 1, -1, -1):
        s = ids[:, row * lanes : (row + 1) * lanes]
        k = s.shape[1]
        f, y = freq[s], x[:, :k]
        full = y >= f * cap
        words[:, row, :k], mask[:, row, :k] = y, full
        y = np.where(full, y >> _32, y)
        q = y // f
        x[:, :k] = (q << _U(PRECISION)) + (y - q * f) + start[s]
        if row % every == 0:
            checks[row // every] = x
    return words, mask, checks


def encode_frame(ids: np.ndarray, lanes: int = LANES, block: int = BLOCK, every: int = CHECK_ROWS) -> bytes:
    """A self-contained frame of these token ids."""
    counts = np.bincount(ids).astype(np.int64) if len(ids) else np.zeros(1, np.int64)
    freq = normalise(counts) if len(ids) else counts
    symbols = np.flatnonzero(freq)
    table = zlib.compress(_varints(np.diff(symbols, prepend=0)) + _varints(freq[symbols]), 6)
    out = [MAGIC, struct.pack("<BIIIQII", PRECISION, lanes, block, every, len(ids), len(symbols), len(table)), struct.pack("<I", zlib.crc32(table)), table]
    f, c = freq.astype(_U), (np.cumsum(freq) - freq).astype(_U)
    whole = len(ids) // block
    for part in (ids[: whole * block].reshape(whole, block), ids[whole * block :].reshape(1, -1)):
        if not part.size:
            continue
        words, mask, checks = _code(part, f, c, lanes, every)
        for b in range(len(part)):
            stream = words[b][mask[b]].astype("<u4").tobytes()
            place = np.concatenate([[0], np.cumsum(mask[b].sum(1))])[: len(mask[b]) : every].astype("<u4").tobytes()
            states = np.ascontiguousarray(checks[:, b]).astype("<u8").tobytes()
            body = place + states + stream
            out += [struct.pack("<IIIII", part.shape[1], len(checks), len(stream), zlib.crc32(body), zlib.crc32(np.ascontiguousarray(part[b], "<u4"))), body]
    return b"".join(out)


def decode_frame(frame: bytes) -> np.ndarray:
    """The token ids of a frame; raises ValueError if a checksum doesn't hold."""
    if frame[:8] != MAGIC:
        raise ValueError("not a frame")
    precision, lanes, block, every, n, symbols, size = struct.unpack_from("<BIIIQII", frame, 8)
    at = 8 + struct.calcsize("<BIIIQII")
    (crc,) = struct.unpack_from("<I", frame, at)
    table = frame[at + 4 : at + 4 + size]
    at += 4 + size
    if zlib.crc32(table) != crc:
        raise ValueError("the frequency table is damaged")
    if not n:
        return np.zeros(0, np.uint32)
    numbers = _read_varints(zlib.decompress(table))
    symbol, freq = np.cumsum(numbers[:symbols]), numbers[symbols:]
    slot = np.repeat(np.arange(symbols), freq)
    f, c = freq.astype(_U), (np.cumsum(freq) - freq).astype(_U)
    sections: dict[int, list] = {}  # by tokens in a section: where its ids go, its states and words
    checks, done = [], 0
    while done < n:
        tokens, places, length, crc, ids_crc = struct.unpack_from("<IIIII", frame, at)
        body = frame[at + 20 : at + 20 + places * (4 + 8 * lanes) + length]
        at += 20 + len(body)
        if zlib.crc32(body) != crc:
            raise ValueError("a block's words are damaged")
        place = np.frombuffer(body, "<u4", places)
        states = np.frombuffer(body, "<u8", places * lanes, 4 * places).reshape(places, lanes)
        words = np.frombuffer(body, "<u4", length // 4, places * (4 + 8 * lanes))
        for k in range(places):
            own = min(tokens - k * every * lanes, every * lanes)
            end = place[k + 1] if k + 1 < places else len(words)
            sections.setdefault(own, []).append((done + k * every * lanes, states[k], words[place[k] : end]))
        checks.append((done, tokens, ids_crc))
        done += tokens
    out = np.zeros(n, np.uint32)
    for own, members in sections.items():
        for part in (members[i : i + 64] for i in range(0, len(members), 64)):
            got = _decode(own, lanes, precision, slot, f, c, [m[1] for m in part], [m[2] for m in part])
            for (to, _, _), ids in zip(part, got, strict=True):
                out[to : to + own] = symbol[ids]
    for start, tokens, ids_crc in checks:
        if zlib.crc32(out[start : start + tokens].astype("<u4")) != ids_crc:
            raise ValueError("a block's ids are damaged")
    return out


def _decode(n: int, lanes: int, precision: int, slot: np.ndarray, f: np.ndarray, c: np.ndarray, states: list, words: list) -> np.ndarray:
    """Decode n tokens of each section, all sections in lockstep."""
    x = np.array(states, _U)
    stream = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(_U)
    size = np.array([len(w) for w in words])
    at = (np.cumsum(size) - size)[:, None]
    out = np.zeros((len(words), n), np.int64)
    low = _U((1 << precision) - 1)
    for row in range(-(-n // lanes)):
        y = x[:, : min(lanes, n - row * lanes)]
        k = y.shape[1]
        r = y & low
        s = slot[r.astype(np.int64)]
        out[:, row * lanes : row * lanes + k] = s
        y = f[s] * (y >> _U(precision)) + r - c[s]
        need = y < LOW
        upto = np.cumsum(need, axis=1)
        y = np.where(need, (y << _32) | stream[np.minimum(at + upto - 1, len(stream) - 1)], y)
        at = at + upto[:, -1:]
        x[:, :k] = y
    return out


def _segments(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("shard", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("before", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("doc_tokens", T.ArrayType(T.LongType())), T.StructField("frame", T.BinaryType())])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str | None = None, end_id: int = 2, segment_tokens: int = 2_000_000) -> DataFrame:
    """Segments (the rows of the file format) of all documents, in ascending doc_id order by shard and segment."""
    source = id_and_text(docs, id_col, text_col)
    schema = _segments(source.schema["doc_id"].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    arrow = T.StructType(schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent.value)
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, parts, counts, held, segment, before
            ids, n = np.concatenate(parts), np.concatenate(counts)
            who = pa.concat_arrays(names)
            one = np.array([0, len(n)], np.int32)
            row = [pa.array([shard]), pa.array([segment]), pa.array([before]), pa.array([len(ids)]), pa.ListArray.from_arrays(one, who), pa.ListArray.from_arrays(one, pa.array(n)), pa.array([encode_frame(ids)], pa.binary())]
            segment, before, names, parts, counts, held = segment + 1, before + len(ids), [], [], [], 0
            return pa.RecordBatch.from_arrays(row, arrow.names)

        for batch in batches:
            for a, b in slices(batch.column(1), TOKEN_SLICE):
                part = batch.slice(a, b - a)
                ids, n = coder.encode(part.column(1).to_pylist())
                parts.append(np.insert(ids, np.cumsum(n), end_id))
                counts.append(n + 1)
                names.append(part.column(0))
                held += len(parts[-1])
                if held >= segment_tokens:
                    yield flush()
        if held:
            yield flush()

    ordered = source.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    return ordered.mapInArrow(run, schema)


def decode_documents(files: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents from segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    kind = files.schema["doc_ids"].dataType.elementType
    totals = sorted(files.groupBy("shard").agg(F.sum("tokens").alias("n")).collect())  # a row for each partition that was written
    upto = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()
    base = {r["shard"]: upto[i] for i, r in enumerate(totals)}
    fields = [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                who, n = batch.column(2)[i].values, np.asarray(batch.column(3)[i].values, dtype=np.int64)
                ids = decode_frame(batch.column(4)[i].as_py()).astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                cols = [who, pa.array(base[shard] + before + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return files.select("shard", "before", "doc_ids", "doc_tokens", "frame").mapInArrow(run, T.StructType(fields))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the files, read them back and decode them."""
    return decode_documents(written(encode_documents(docs, **options), "rans"))
