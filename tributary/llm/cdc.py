"""Substring dedup by content-defined chunking with a gear rolling hash (operator 5).

A gear hash (32 bits: it depends on the last 32 bytes only) is taken at the start of every word; cuts are the places whose hash
is the least in some run of ``WINDOW`` consecutive places, so they are set by the content alone, move with it when text is
inserted before, and are never more than ``WINDOW`` words apart.  Chunks between cuts are deduplicated by a 64-bit digest: the first occurrence (lowest doc_id, then
place) stays.  Runs of neighbouring repeated chunks count as a repeated passage from ``MIN_WORDS`` words on.  With these
values each passage of 50 words that is repeated exactly is found: of its words the first five or six (32 bytes) and then up to eleven
at each end may belong to chunks that reach beyond it, and at least 20 are left.

Digests are counted by hash aggregation over plain numbers (a digest that everyone has costs one row a task), and meet the chunks
again in a join whose two sides are plain shuffles, which adaptive execution splits if a digest is hot.  What comes first within
a text is seen while it is cut, so only the lowest doc_id of a digest is looked for.  Nothing is collected.

Edge cases: rows with null doc_id or null or blank text have no chunks and stay as they are; rows that share a doc_id are one
document: what comes first in it stays in each of its rows, and no row is cut by another row's places; text without white space is
cut at hashed places about 16 bytes apart instead of words; an empty table gives no rows; further columns are carried along
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_KEYS, SPACE, id_and_text, release, slices, spans_hash, utf8, written, Words

WINDOW, MIN_WORDS, REACH = 12, 20, 32
#: Bytes of text that are cut at once: a worker's memory is about a hundred times that.
SLICE = 400_000
#: Shorter chunks of a passage must come from the document that a neighbour comes from, or lie between longer ones, or in a run of
#: repeated chunks of at least ``LONG_RUN`` words.
STRAY_WORDS, LONG_RUN = 8, 50
#: Words of more bytes than this are cut inside, too.
LONG_WORD = 64
GEAR = (BYTE_KEYS >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """The gear hash up to each byte: h[i] = 2 h[i-1] + GEAR[buf[i]] modulo 2**32, by doubling the reach of partial sums."""
    h = GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def _spread(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of x[i : i + width], for each i where it fits."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def chunk_texts(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Chunks of all texts: text number, number in the text, start and end byte in it, words, digest."""
    words = Words(texts, gap=REACH)
    buf = np.where(SPACE[words.buf], np.uint8(0x20), words.buf)
    h = gear(buf)
    places, owner, ends = words.starts, words.text, words.ends
    long = np.flatnonzero(words.ends - words.starts > LONG_WORD)
    if len(long):
        inner = np.concatenate([np.arange(a + 1, b) for a, b in zip(words.starts[long], words.ends[long], strict=True)])
        inner = inner[((h[inner - 1] & 15) == 0) & ((buf[inner] & 0xC0) != 0x80)]
        if len(inner):
            order = np.argsort(np.concatenate([places, inner]), kind="stable")
            of = np.searchsorted(words.starts, inner, "right") - 1
            places = np.concatenate([places, inner])[order]
            owner = np.concatenate([owner, words.text[of]])[order]
            ends = np.concatenate([ends, words.ends[of]])[order]
            ends[:-1] = np.where(places[1:] < ends[:-1], places[1:], ends[:-1])
    n = len(places)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    v = h[places - 1].astype(np.int64) + 1
    cut = np.concatenate([[True], owner[1:] != owner[:-1]])
    if n >= window:
        low = _spread(v, window, np.minimum)
        low[owner[: n - window + 1] != owner[window - 1 :]] = 0  # runs that cross texts
        edge = np.zeros(window - 1, np.int64)
        cut |= v == _spread(np.concatenate([edge, low, edge]), window, np.maximum)
    at = np.flatnonzero(cut)
    last = np.concatenate([at[1:], [n]]) - 1
    starts, stops, who = places[at], ends[last], owner[at]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    seq = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
    base = words.base[who]
    return who, seq, starts - base, stops - base, last - at + 1, spans_hash(buf, starts, stops).view(np.int64)


def _again(who: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which chunks repeat an earlier one of their own text."""
    order = np.lexsort((np.arange(len(who)), digest, who))
    same = (who[order][1:] == who[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    out = np.zeros(len(who), bool)
    out[order[1:][same]] = True
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (a hash that tells texts of one doc_id apart), seq, start, end (bytes), words, digest of every chunk, and again:
    whether its text has the digest before."""
    source = id_and_text(docs, id_col, text_col).where("doc_id is not null and text is not null")
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("text", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("seq", "start", "end", "words")), T.StructField("digest", T.LongType()), T.StructField("again", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                texts = utf8(part.column(1))
                who, seq, start, end, words, digest = chunk_texts(texts)
                small = (pa.array(x.astype(np.int32)) for x in (seq, start, end, words))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(text_keys(texts)[who]), *small, pa.array(digest), pa.array(_again(who, digest))], schema.names)
        release()

    return source.mapInArrow(run, schema)


def text_keys(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) >> 1 for t in texts), np.int64, len(texts))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """Chunks within repeated passages of at least ``min_words`` words: doc_id, text, seq, start, end, words, copies, run, first.

    run numbers the passages of a text; first: this is the digest's first occurrence, which stays."""
    every = written(chunks(docs, id_col, text_col), "chunks")
    seen = every.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies"))
    repeated = written(seen.where("copies > 1"), "digests", every.count() // 2)
    hits = every.join(repeated, "digest").drop("digest")
    order = Window.partitionBy("doc_id", "text").orderBy("seq")
    hits = hits.withColumn("before", F.lag("seq").over(order)).where("before is null or before <> seq")  # equal rows
    near = lambda f, step, c: F.when(f("seq").over(order) == F.col("seq") + step, f(c).over(order))
    beside = {f"{side}_{c}": near(f, step, c) for side, f, step in (("last", F.lag, -1), ("next", F.lead, 1)) for c in ("keeper", "words")}
    hits = hits.withColumns({"run": F.col("seq") - F.row_number().over(order), **beside})
    mine = Window.partitionBy("doc_id", "text", "run")
    long = hits.withColumn("run_words", F.sum("words").over(mine)).where(F.col("run_words") >= min_words)
    # A short chunk whose first document is neither neighbour's may be a common phrase beside the passage, unless long ones enclose it.
    alike = F.coalesce(F.col("keeper") == F.col("last_keeper"), F.lit(False)) | F.coalesce(F.col("keeper") == F.col("next_keeper"), F.lit(False))
    enclosed = F.coalesce(F.least("last_words", "next_words") >= STRAY_WORDS, F.lit(False)) & F.col("last_words").isNotNull() & F.col("next_words").isNotNull()
    long = long.withColumn("core", F.when((F.col("words") >= STRAY_WORDS) | alike | enclosed, F.col("keeper")))
    # Between core chunks it belongs to the passage if they come from one document, or if the run is a long one; so does all of a
    # long run without any.
    nearest = lambda at: F.last("core", ignorenulls=True).over(mine.orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    before, after = nearest(F.asc("seq")), nearest(F.desc("seq"))
    long = long.withColumns({"core_before": before, "core_after": after, "cores": F.count("core").over(mine)})
    between, whole = F.col("core_before").isNotNull() & F.col("core_after").isNotNull(), F.col("run_words") >= LONG_RUN
    kept = F.col("core").isNotNull() | between & (whole | (F.col("core_before") == F.col("core_after"))) | whole & (F.col("cores") == 0)
    first = (F.col("doc_id") == F.col("keeper")) & ~F.col("again")
    out = long.where(kept).withColumn("run", F.col("seq") - F.row_number().over(order))
    return out.select("doc_id", "text", "seq", "start", "end", "words", "copies", "run", first.alias("first"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each repeated passage of a text: doc_id, start, end (bytes), words, copies (of its most repeated chunk),
    removed_words (those that dedup removes: all that also occur earlier)."""
    hits = repeated_chunks(docs, id_col, text_col, min_words=min_words)
    return hits.groupBy("doc_id", "text", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.max("copies").alias("copies"), F.sum(F.when(F.col("first"), 0).otherwise(F.col("words"))).alias("removed_words")
    ).drop("text", "run")


def without(text: str, spans: list[int]) -> str:
    """The text without these spans of its bytes (start, end, start, end, ...); white space that a cut leaves at the start of what
    follows goes, if what precedes it ends in white space."""
    data, at, kept = text.encode(), 0, []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(x.lstrip(b" \t\r") if i and kept[i - 1][-1:].isspace() else x for i, x in enumerate(kept)).decode()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with all columns, without the chunks of repeated passages that occur earlier; documents of which nothing
    but white space is left go."""
    spans = repeated_chunks(docs, id_col, text_col, min_words=min_words).where(~F.col("first"))
    cuts = spans.groupBy("doc_id", "text").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    one = F.struct("text", F.flatten(F.transform("s", lambda x: F.array(x["start"], x["end"]))).alias("spans"))
    cuts = written(cuts.groupBy("doc_id").agg(F.collect_list(one).alias("cuts")), "cuts")  # several only where rows share a doc_id
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    plain = docs.toDF(*names)  # names of our own, so that none can clash
    joined = plain.join(cuts.withColumnRenamed("doc_id", "cut_id"), F.col(names[docs.columns.index(id_col)]) == F.col("cut_id"), "left")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in slices(batch.column(place), SLICE):
                part = batch.slice(a, b - a)
                old = utf8(part.column(place))
                new: list = part.column(place).to_pylist()
                keep = np.ones(len(new), bool)
                cut_here = part.column(len(names))
                for i in np.flatnonzero(np.asarray(cut_here.is_valid())).tolist():
                    key = int(text_keys([old[i]])[0])
                    spans = next((x["spans"] for x in cut_here[i].as_py() if x["text"] == key), None)
                    if spans and new[i] is not None:
                        new[i] = without(new[i], spans)
                        keep[i] = bool(new[i].strip())
                texts = pa.array(new, part.column(place).type)
                yield pa.RecordBatch.from_arrays([texts if i == place else part.column(i) for i in range(len(names))], schema.names).filter(pa.array(keep))
        release()

    return joined.select(*names, "cuts").mapInArrow(run, schema)
