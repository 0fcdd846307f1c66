"""Near-duplicate classes by ProbMinHash, banding and exact verification (operator 7).

1. One scan gives each document a 128-bit digest of its text and a ProbMinHash signature of its distinct word shingles (five
   words; each of weight 1, as verification counts them, whatever its occurrences): elements arrive as Poisson processes of the rate of their weights, each arrival falls in
   a random register, a register keeps its first arrival's element, and an element stops once its next arrival is later than
   the last register's first one.  Registers of two texts agree with the probability Jaccard similarity, which is the plain
   one of the sets for weights of 1.
2. Equal texts are collapsed by digest; the rest goes on over distinct texts, each known by a 64-bit hash (its node).
3. ``BANDS`` bands of ``ROWS`` registers: texts of similarity 0.8 share a bucket with probability 0.9999.  Of buckets that hold the same
   texts one is kept.
4. Verification by the exact Jaccard similarity of shingle sets (of 48-bit hashes).  Rounds: every text of a bucket is held against
   the bucket's pivot (a random member, another one each round) unless both are connected already.  Buckets that still hold several
   components are finished exactly: the texts outside the bucket's largest component are held against all of its texts
   in blocks of about ``BLOCK`` x ``BLOCK``, and a block gives links of a forest, not pairs.  Texts of buckets that would compare more
   than ``LIMIT`` x ``LIMIT`` pairs are first dealt by their rarest shingles, a prefix filter that loses no pair of the similarity.  Thus connectivity is
   that of all pairs in all buckets, while large groups of copies cost a few rounds.
5. Connected components by distributed label propagation.  No link, component or digest is collected.

Edge cases: rows with null doc_id are not classified; a null text is in a class of its own; empty texts and texts of white
space are equal only to the same text; a text of less than five words is one shingle; rows that share a doc_id are classified by
their own texts (equal rows count once), and a class that holds several texts of its lowest doc_id keeps the one of the lowest hash;
an empty table gives no rows; further columns are ignored (``keep_one`` carries them along, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, mix, release, slices, utf8, written, Words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
ROUNDS, BLOCK, LIMIT = 2, 256, 1024
U = np.uint64
_PHI = U(0x9E3779B97F4A7C15)
_PLACE = [U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted: text number, 48-bit shingle id, occurrences."""
    words = Words(texts)
    h, n = words.hashes(), len(words.starts)
    own = np.minimum(np.arange(n) + size, words.first[words.text] + words.count[words.text]) - np.arange(n) if n else np.zeros(0, np.int64)
    value = own.astype(U) * _PHI
    for j in range(size):
        at = np.minimum(np.arange(n) + j, n - 1)
        value = value + np.where(j < own, h[at] * (_PLACE[j % 5] + U(2 * (j // 5))), U(0))
    whole = (own == size) | (np.arange(n) == words.first[words.text])  # a short text is one shingle
    key = np.sort(words.text[whole].astype(U) << U(48) | mix(value[whole]) >> U(16))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(key)]])) if len(key) else new
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), count


def signatures(n: int, text: np.ndarray, element: np.ndarray, weight: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: texts x registers of element ids (0 where a text has no elements)."""
    first = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, U)
    latest = np.full(n, np.inf)
    seed, at = mix(element * _PHI + U(1)), np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        draw = mix(seed + U(step * int(_PLACE[2]) % (1 << 64)))
        at = at - np.log1p(-((draw >> U(11)).astype(np.float64) * 2.0**-53)) / weight
        live = at < latest[text]
        if not live.all():
            text, element, weight, seed, at, draw = (x[live] for x in (text, element, weight, seed, at, draw))
        cell = text * registers + ((mix(draw ^ _PHI) >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        np.minimum.at(first, cell, at)
        won = first[cell] == at
        held[cell[won]] = element[won]
        if step < 8 or step % 8 == 0:
            some = np.unique(text) if step > 2 else np.arange(n)
            latest[some] = first.reshape(n, registers)[some].max(1)
    return held.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * _PHI, x.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + x[:, :, r])
    return key.view(np.int64)


def _scan(source: DataFrame) -> DataFrame:
    """doc_id, node, a text digest (two longs), size (distinct shingles) and band keys of each (doc_id, text, node)."""
    import xxhash

    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("node", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = utf8(part.column(1))
                n = len(texts)
                text, element, _ = shingles(texts)
                keys = band_keys(signatures(n, text, element, np.ones(len(element))))
                size = np.bincount(text, minlength=n)
                some = size > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), ">i8").reshape(n, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))], schema.names)
        release()

    return source.mapInArrow(run, schema)


def _sets(source: DataFrame) -> DataFrame:
    """rep, set: the sorted 48-bit shingle ids of each (rep, text), six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                text, element, _ = shingles(utf8(part.column(1)))
                packed = np.ascontiguousarray(element.astype("<u8")[:, None].view(np.uint8)[:, :6])
                edges = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["rep", "set"])
        release()

    return source.mapInArrow(run, T.StructType([T.StructField("rep", source.schema["rep"].dataType), T.StructField("set", T.BinaryType())]))


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _close(a: str, b: str, similarity: float):
    """Whether two sizes allow the similarity."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, ...) whose sets are that similar."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")
    schema = T.StructType([rows.schema["a"], rows.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            last, a = None, None
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x = x.as_py()
                if x != last:
                    last, a = x, _unpack(x)
                keep.append(jaccard(a, _unpack(y.as_py())) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, schema)


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, comp (the least node of its connected component) for links (a, b).  rows: a bound on the nodes, if one is known."""
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links", rows and 4 * rows)
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels", rows)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # Follow the label to its own label, which halves long paths.
        up = labels.select(F.col("node").alias("__n"), F.col("comp").alias("up"))
        step = step.join(up, F.col("comp") == F.col("__n"), "left").select("node", "old", F.least("comp", "up").alias("comp"))
        step = written(step, "labels", rows)
        labels = step.select("node", "comp")
        if step.where("comp <> old").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """labels (rep, comp) after links between comps."""
    found = components(links, rows).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return written(labels.join(found, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "comps", rows)


def _different(every: DataFrame) -> DataFrame:
    """key: one bucket of (key, rep) for each set of two or more texts.  Near copies share most of their bands, so most buckets
    hold the same texts as others and would give the same pairs again.  A set is known by its number and its hashes' exclusive or."""
    sets = every.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("h")).where("n > 1")
    return sets.groupBy("n", "h").agg(F.min("key").alias("key")).select("key")


def _rest(members: DataFrame, sets: DataFrame, similarity: float, limit: int = LIMIT, rows: int | None = None) -> DataFrame:
    """Links (a, b) between components in buckets (key, rep, size, comp) that hold several; but for buckets of two texts, which the
    first round has compared.

    A bucket's texts outside its largest component meet all of its texts.  Where these are more than ``limit`` x ``limit`` pairs, which a
    passage common to very many texts makes, texts meet by prefixes instead: see _prefixes."""
    by = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = by.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("comps")).where("comps > 1 and n > 2")
    sizes = written(sizes.select("key", (F.col("n") * (F.col("n") - F.col("most")) > limit * limit).alias("large")), "sizes", rows)
    small = members.join(sizes.where("not large").select("key"), "key")
    large = members.join(sizes.where("large").select("key"), "key")
    own = written(large.groupBy("rep").agg(F.first("size").alias("size"), F.first("comp").alias("comp")), "large", rows)
    columns = ["key", "rep", "size", "comp"]
    met = own.join(_prefixes(own.select("rep", "size"), sets, similarity), "rep")
    return _blocks(written(small.select(*columns).unionByName(met.select(*columns)), "unresolved"), sets, similarity, rows)


def _prefixes(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """key, rep: each of the texts (rep, size) under the rarest of its shingles, so many that two texts of the similarity share one.

    In one order of all shingles (by how many of the texts have them, then by id) the first n - ceil(similarity n) + 1 of n shingles
    of two such texts have one in common, since otherwise fewer than ceil(similarity n) of one are in the other.  Shingles of a
    single text come first and meet nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [_unpack(x) for x in part.column(1).to_pylist()]
                which = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array(np.concatenate(found).astype(np.int64))], ["rep", "key"])

    each = sets.join(texts, "rep", "left_semi").select("rep", "set").mapInArrow(run, T.StructType([T.StructField("rep", sets.schema["rep"].dataType), T.StructField("key", T.LongType())]))
    common = written(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "common")
    ranked = each.join(common, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("all"))
    length = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)) + 1 - (F.col("size") - F.size("all"))
    first = ranked.join(texts, "rep").withColumn("length", length.cast("int")).where("length > 0")
    return first.select("rep", F.explode(F.slice("all", F.lit(1), F.col("length"))).alias("x")).select("x.key", "rep")


def _blocks(members: DataFrame, sets: DataFrame, similarity: float, rows: int | None = None) -> DataFrame:
    """As _rest, for buckets as they are, exactly, in blocks."""
    by = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    stats = by.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    stats = written(stats.select("key", F.col("most.comp").alias("major"), F.ceil(F.col("n") / BLOCK).alias("rows"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("cols")), "stats", rows)
    m = members.join(stats, "key").join(sets, "rep")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = m.select("key", own("rows").alias("row"), spread("cols").alias("col"), "rep", "comp", "set", F.lit(False).alias("odd"))
    odd = m.where("comp <> major").select("key", spread("rows").alias("row"), own("cols").alias("col"), "rep", "comp", "set", F.lit(True).alias("odd"))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        group: dict = {}

        def find(x):
            while group.setdefault(x, x) != x:
                group[x] = x = group[group[x]]
            return x

        rows, cols = frame[~frame["odd"]], frame[frame["odd"]]
        out: list = []
        sets_ = [_unpack(s) for s in rows["set"]]
        if not sets_ or not len(cols):
            return pd.DataFrame({"a": [], "b": []}).astype({"a": frame["comp"].dtype, "b": frame["comp"].dtype})
        sizes = np.array([len(s) for s in sets_])
        ids = np.concatenate(sets_)
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], np.repeat(np.arange(len(sets_)), sizes)[order]
        comp = rows["comp"].tolist()
        for c, s in zip(cols["comp"].tolist(), cols["set"], strict=True):
            x = _unpack(s)
            lo, hi = np.searchsorted(ids, x, "left"), np.searchsorted(ids, x, "right")
            n = hi - lo
            hit = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            both = np.bincount(hit, minlength=len(sets_))
            for i in np.flatnonzero(both >= similarity * (sizes + len(x) - both)):
                a, b = find(comp[i]), find(c)
                if a != b:
                    group[max(a, b)] = min(a, b)
                    out.append((comp[i], c))
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": frame["comp"].dtype, "b": frame["comp"].dtype})

    kind = members.schema["comp"].dataType
    return every.union(odd).groupBy("key", "row", "col").applyInPandas(block, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, node) of the rows that have a doc_id; node: what a text is known by, null without one."""
    return id_and_text(docs, id_col, text_col).where("doc_id is not null").withColumn("node", F.when(F.col("text").isNotNull(), F.xxhash64("text")))


def _found(source: DataFrame, similarity: float, limit: int) -> DataFrame:
    """doc_id, node, comp (the class, by the least of its nodes), class_id, text_id of each row that has a text."""
    texts = source.where("text is not null")
    seen = written(_scan(texts), "signatures")
    reps = written(seen.groupBy("node", "h1", "h2").agg(F.min("doc_id").alias("text_id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "texts")
    rows = reps.count()
    every = reps.select(F.col("node").alias("rep"), "size", F.explode("bands").alias("key"))
    buckets = written(every.join(_different(every), "key"), "buckets", BANDS * rows)
    labels = written(buckets.select("rep").distinct().select("rep", F.col("rep").alias("comp")), "comps", rows)
    chosen = reps.join(labels, reps["node"] == labels["rep"], "left_semi").select("node", F.col("text_id").alias("doc_id"))
    sets = written(_sets(texts.join(chosen, ["node", "doc_id"], "left_semi").dropDuplicates(["node"]).select(F.col("node").alias("rep"), "text")), "sets")

    for turn in range(ROUNDS):
        m = buckets.join(labels, "rep")
        pivot = F.min_by(F.struct(F.col("rep").alias("a"), F.col("comp").alias("a_comp"), F.col("size").alias("a_size")), F.xxhash64("rep", F.lit(turn)))
        tops = m.groupBy("key").agg(pivot.alias("p"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key", "p.*")
        pairs = m.join(tops, "key").where("comp <> a_comp").where(_close("size", "a_size", similarity)).select("a", F.col("rep").alias("b"), "a_comp", F.col("comp").alias("b_comp")).distinct()
        pairs = written(pairs, "pairs", 4 * rows)
        links = pairs.join(_verified(pairs.select("a", "b"), sets, similarity), ["a", "b"]).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct()
        links = written(links, "verified", rows)
        if not links.isEmpty():
            labels = _merged(labels, links, rows)
    links = written(_rest(buckets.join(labels, "rep"), sets, similarity, limit, rows), "rest", rows)
    if not links.isEmpty():
        labels = _merged(labels, links, rows)

    member = reps.select("node", "h1", "h2", "text_id").join(labels, reps["node"] == labels["rep"], "left")
    heads = member.where("comp is not null").groupBy("comp").agg(F.min("text_id").alias("class_id"))
    known = written(member.join(heads, "comp", "left").select("node", "h1", "h2", "text_id", F.coalesce("comp", "node").alias("comp"), F.coalesce("class_id", "text_id").alias("class_id")), "classes", rows)
    return seen.select("doc_id", "node", "h1", "h2").join(known, ["node", "h1", "h2"]).select("doc_id", "node", "comp", "class_id", "text_id")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """doc_id, class_id (the lowest doc_id of its class), text_id (the lowest doc_id with an equal text)."""
    source = _source(docs, id_col, text_col)
    found = _found(source, similarity, limit).select("doc_id", "class_id", "text_id")
    alone = source.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """The documents, with all columns, that are their class's lowest doc_id (one row each), and all rows that have no doc_id or no
    text."""
    source = _source(docs, id_col, text_col)
    found = written(_found(source, similarity, limit), "found")
    first = found.where("doc_id = class_id").groupBy("comp").agg(F.min("node").alias("kept_node"), F.min("doc_id").alias("kept_id")).drop("comp")
    names = [f"c{i}" for i in range(len(docs.columns))]  # names of our own, so that none can clash
    own, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    plain = docs.toDF(*names)
    one = plain.withColumn("kept_node", F.xxhash64(text.cast("string"))).withColumn("kept_id", own).where(own.isNotNull() & text.isNotNull())
    one = one.join(first, ["kept_id", "kept_node"], "left_semi").dropDuplicates(["kept_id", "kept_node"]).select(*names)
    return one.unionByName(plain.where(own.isNull() | text.isNull())).toDF(*docs.columns)
