"""Language identification by a string kernel (operator 4).

The blended-spectrum presence kernel of two texts is the number of character n-grams (1 to 4 bytes of lower-cased UTF-8, hashed
to ``DIMS`` places) that both have, over the geometric mean of their numbers of n-grams.  ``LANDMARKS`` training segments span
the Nystroem feature map; one-versus-rest kernel ridge regression is solved in it.  Since the kernel is an inner product of
normalised presence vectors, landmarks, map and regression fold into one weight matrix, and a batch of segments is scored by one
matrix product of its presence matrix with these weights.  Whole texts are scored, in segments of ``SEGMENT`` bytes, whose scores are
averaged by length.

What is learned comes from a bounded sample of labelled rows: ``per_language`` documents of each language by hash order, at most
``sample`` in all, ``segments`` segments of each spread over the whole text.  The driver gets their packed presence vectors (2 KB each) and nothing else.

Edge cases: a null text or one without a letter is "und" with score 0; so is every text if there is nothing to learn from; null
ids are not held out and not learned from; repeated rows give a row each; texts may be of any length; an empty table gives no
rows; further columns are ignored (``keep_identified`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import release, slices

BITS = 14
DIMS, GRAMS, SEGMENT, LANDMARKS = 1 << BITS, 4, 2048, 256
RIDGE, SHARPNESS = 1e-3, 4.0
BATCH = 256
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is of one of Unicode's letter categories (so no digits, fractions, circled or Roman numerals)."""
    return any(map(str.isalpha, text))


def normalised(text: str) -> bytes:
    """Lower case; everything in ASCII that is no letter becomes a space."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE)


def presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram presence of each segment (segments x DIMS, bytes 0 or 1), the segment's text and its length."""
    gap = b" " * GRAMS
    buf = np.frombuffer(gap.join([*texts, b""]), np.uint8).astype(np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    per = -(-lens // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(SEGMENT, lens[owner] - nth * SEGMENT)
    start = (np.cumsum(lens + GRAMS) - lens - GRAMS)[owner] + nth * SEGMENT
    row = np.repeat(np.arange(len(owner)), length) << BITS
    at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    out = np.zeros(len(owner) << BITS, np.uint8)
    code = np.zeros(len(buf), np.uint32)
    for n in range(1, GRAMS + 1):
        # The code of the n bytes from each place on; the gap keeps texts apart.
        code = code + np.concatenate([buf[n - 1 :], np.full(n - 1, 32, np.uint32)]) * np.uint32(pow(16_777_619, n, 1 << 32))
        place = (code * np.uint32(2_654_435_769) + np.uint32(n * 40_503)) ^ (code >> np.uint32(15))
        out[row | ((place * np.uint32(2_246_822_519)) >> np.uint32(32 - BITS))[at].astype(np.int64)] = 1
    return out.reshape(-1, DIMS), owner, length


class Model:
    """Languages, weights (DIMS x languages) and biases."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def segment_scores(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(x.sum(1, dtype=np.float32))[:, None]
        return (x.astype(np.float32) @ self.weights) / np.maximum(norm, 1) + self.bias

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Whether a text can be judged, and its regression value for each language (about 1 for its own and -1 for others)."""
        known = np.array([bool(x and self.languages and has_letter(x)) for x in texts], bool)
        clean = [normalised(x) if k else b"" for x, k in zip(texts, known, strict=True)]
        total, weight = np.zeros((len(texts), max(1, len(self.languages)))), np.zeros(len(texts))
        for i, j in _groups(clean):
            x, owner, length = presence(clean[i:j])
            for a in range(0, len(owner), BATCH):
                part = slice(a, a + BATCH)
                np.add.at(total, owner[part] + i, self.segment_scores(x[part]) * length[part, None])
            np.add.at(weight, owner + i, length)
        return known, total / np.maximum(weight, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        known, value = self.margins(texts)
        margin = SHARPNESS * value
        likely = np.exp(margin - margin.max(1, keepdims=True))
        best = margin.argmax(1)
        score = np.where(known, likely[np.arange(len(texts)), best] / likely.sum(1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known, strict=True)], score

    def lead(self, texts: list[str | None]) -> np.ndarray:
        """How far the best language's value is above the runner-up's; -1 for a text that can't be judged.  It doesn't depend on how
        many languages there are; with one language it is that one's value above 0."""
        return self.judge(texts)[1]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, as ``predict``, and its lead."""
        known, value = self.margins(texts)
        two = np.sort(value, 1)[:, -2:]
        return [self.languages[b] if k else "und" for b, k in zip(value.argmax(1).tolist(), known, strict=True)], np.where(known, two[:, -1] - (two[:, 0] if value.shape[1] > 1 else 0.0), -1.0)


def _groups(texts: list[bytes], segments: int = 256) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many segments."""
    at, n = 0, 0
    for i, x in enumerate(texts):
        n += -(-len(x) // SEGMENT)
        if n >= segments:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def fit(vectors: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on packed presence vectors, in the Nystroem space of landmarks taken from all languages in turn."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((DIMS, 1), np.float32), np.zeros(1))
    target = np.array([languages.index(x) for x in labels])
    turns = np.concatenate([np.arange(n) for n in np.bincount(target)])
    order = np.argsort(target, kind="stable")
    chosen = order[np.lexsort((target[order], turns))][:landmarks]
    unit = lambda rows: (x := np.unpackbits(vectors[rows], axis=1).astype(np.float32)) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    marks = unit(chosen)
    kernel = np.concatenate([unit(np.arange(i, min(i + 512, len(vectors)))) @ marks.T for i in range(0, len(vectors), 512)]).astype(np.float64)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    feature = kernel @ root
    mean = feature.mean(0)
    centred = feature - mean
    # Every language counts the same, however many segments it has.
    share = (1.0 / np.bincount(target))[target][:, None]
    wanted = np.where(target[:, None] == np.arange(len(languages)), 1.0, -1.0)
    level = (wanted * share).sum(0) / share.sum()
    solved = np.linalg.solve(centred.T @ (centred * share) + ridge * np.eye(keep.sum()), centred.T @ ((wanted - level) * share))
    return Model(languages, (marks.T @ (root @ solved)).astype(np.float32), level - mean @ solved)


def train(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, sample: int = 12_800, segments: int = 2) -> Model:
    """Fit on a bounded sample of the rows for which ``learn`` holds: at most ``sample`` of them, at most ``per_language`` of each of
    the ``sample`` / 4 most frequent languages (rarer ones are not learned)."""
    ship(docs.sparkSession)
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    names = rows.select("lang", "id")
    # Rows below a hash bound that leaves about twice as many of each language as are taken, so no language's rows meet in one task.
    counts = names.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, sample // 4))
    counts = docs.sparkSession.createDataFrame(counts.collect(), "lang string, n long")  # a row for each language
    each = max(4, min(per_language, sample // max(1, counts.count())))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    below = names.join(F.broadcast(counts), "lang").where(place < (2.0 * each + 200) / F.col("n") * 1_000_003)
    order = Window.partitionBy("lang").orderBy(place, "id")
    taken = below.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("id", "lang").distinct()
    some = rows.join(F.broadcast(taken), ["id", "lang"]).select("lang", "text", F.xxhash64("id").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                x, _, length = presence([normalised(batch.column(1)[i].as_py())])
                full = np.flatnonzero(length >= min(SEGMENT // 2, length.max(initial=0)))
                at = full[np.linspace(0, len(full) - 1, min(segments, len(full))).round().astype(int)]
                packed = [np.packbits(v).tobytes() for v in x[at]]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(at), pa.string()), pa.array(packed, pa.binary()), pa.array([batch.column(2)[i].as_py()] * len(at), pa.int64())], ["lang", "x", "k"])

    got = sorted(some.mapInArrow(run, "lang string, x binary, k long").collect(), key=lambda r: (r["k"], r["lang"], r["x"]))  # at most segments x sample rows
    vectors = np.frombuffer(b"".join(r["x"] for r in got), np.uint8).reshape(len(got), DIMS // 8)
    return fit(vectors, [r["lang"] for r in got])


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; learned from the rows that aren't held out."""
    out = held_out(id_col, folds, fold)
    model = train(docs, ~out, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    source = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([source.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                lang, score = sent.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score)], schema.names)

    return source.mapInArrow(run, schema)


#: On sf0.1 the shortest clean texts lead by 0.0003 and random letters by 0.2 and more, so a higher bar would drop clean texts only.
LEAST_LEAD = 0.0


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_LEAD, **options) -> DataFrame:
    """The documents, with all columns, without those that have no language ("und") and those whose best language leads the runner-up
    by less than ``least``.  The language column holds the language that was identified, in place of the label."""
    model = train(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place, label = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column(place)
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                names, lead = sent.value.judge(texts.slice(a, b - a).to_pylist())
                keep = pa.array(lead >= least)
                own = pa.array(names, pa.string()).filter(keep).cast(part.column(label).type)
                yield part.filter(keep).set_column(label, part.schema.field(label), own)
        release()

    return docs.mapInArrow(run, docs.schema)
