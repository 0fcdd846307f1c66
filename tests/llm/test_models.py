"""Operators 3, 4, 8, 9, 10 and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import LONG, texts_of
from tributary.llm import bloomlm, langid, packing, queries, topk, urlfilter, webp


def _duck(sf_dir: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    assert sorted(map(repr, map(tuple, queries.QUERIES[name](spark, sf_dir).collect()))) == sorted(map(repr, _duck(sf_dir, queries.ORACLES[name])))


# --- top-k ----------------------------------------------------------------------------------------------------------------


def test_search_on_odd_vectors(spark):
    r = random.Random(1)
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [r.uniform(-1, 1) for _ in range(20)]) for i in range(120)] + [(i, [0.5] * 20) for i in range(120, 140)] + [(200, None), (201, [0.1, None]), (202, [nan, 1.0]), (203, [inf, 1.0]), (204, [1.0, 2.0]), (None, [0.5] * 20), (130, [0.5] * 20), (250, []), (300, [1.0, 1.0]), (50, [0.25] * 20), (7, [0.75] * 20)]
    df = spark.createDataFrame([(i, v, 9, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int, score int").repartition(3)
    got = topk.search(df, F.col("vec_id") % 50 == 0, groups=4, block=16, query_block=3)
    good = sorted({(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    want = []
    for q, x in good:
        scores = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in good if i != q and len(v) == len(x)) if q % 50 == 0 else []
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert topk.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_keep_ties_and_large_numbers():
    r = np.random.default_rng(0)
    for scale in (3, 2**27):  # in floats, and beyond what they hold exactly
        c, q = r.integers(-scale, scale, (70, 300)), r.integers(-scale, scale, (70, 7))
        ids, own = np.arange(300), np.arange(290, 297)
        got = topk.best(q, own, c, ids, 5)
        want = []
        for j in range(7):
            s = [(-sum(int(a) * int(b) for a, b in zip(q[:, j], c[:, i], strict=True)), i) for i in range(300) if i != own[j]]
            want += [(int(own[j]), i, -v) for v, i in sorted(s)[:5]]
        mine = [(int(own[j]), int(ids[i]), s) for j, i, s in zip(*(x.tolist() for x in got), strict=True)]
        assert mine == want
        floor = np.full(7, -np.inf)
        parts = [topk.best(q, own, c[:, a : a + 50], ids[a : a + 50], 5, floor) for a in range(0, 300, 50)]
        carried = sorted((int(own[j]), -s, int(ids[a + i])) for a, part in zip(range(0, 300, 50), parts, strict=True) for j, i, s in zip(*(x.tolist() for x in part), strict=True))
        assert [(j, i, -s) for n, (j, s, i) in enumerate(carried) if sum(o[0] == j for o in carried[:n]) < 5] == sorted(want, key=lambda r: (r[0], -r[2], r[1]))


# --- language ID ----------------------------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_string_kernel_langid(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_language_of_odd_documents(spark, odd_documents, no_documents):
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in langid.identify(odd_documents).collect()), key=repr)
    assert len(got) == odd_documents.count()
    und = {d for d, name, _ in got if name == "und"}
    assert und == {2, 3, 4, 9, 13} and all(s == 0 for d, name, s in got if name == "und")
    assert langid.identify(no_documents).count() == 0
    unlabelled = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    kept = langid.keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 6, 8, 11, 11, 12]


def _grams(text: str) -> set:
    b = langid.normalised(text)
    x, _, _ = langid.presence([b])
    assert len(x) == 1
    return set(np.flatnonzero(x[0]).tolist())


def test_scores_are_kernel_ridge_regression():
    """Against dense kernel ridge regression over the landmarks, from the kernel's definition."""
    r = random.Random(2)
    words = {"en": "the cat and dog of this house was".split(), "fr": "le chat et chien de cette maison était".split(), "de": "der die und katze hund von diesem haus".split(), "es": "el gato y perro de esta casa era".split()}
    texts = [(name, " ".join(r.choice(w) for _ in range(12))) for name, w in words.items() for _ in range(10)]
    x, _, _ = langid.presence([langid.normalised(t) for _, t in texts])
    marks = 16
    model = langid.fit(np.packbits(x, axis=1), [name for name, _ in texts], landmarks=marks)
    sets = [_grams(t) for _, t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    chosen = [sets[i * 10 + k] for k in range(marks // 4) for i in (2, 0, 3, 1)]  # languages in turn, by name: de, en, es, fr
    names = sorted(words)
    km = np.array([[kernel(a, b) for b in chosen] for a in chosen])
    kn = np.array([[kernel(a, b) for b in chosen] for a in sets])
    value, vector = np.linalg.eigh(km)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    f = kn @ root
    target = np.array([[1.0 if name == n else -1.0 for n in names] for name, _ in texts])
    # Ridge with an unpenalised bias; each language weighs as much as any other.
    weight = np.full(len(texts), 1 / 10)
    mean, level = f.mean(0), (target * weight[:, None]).sum(0) / weight.sum()
    w = np.linalg.solve((f - mean).T @ ((f - mean) * weight[:, None]) + langid.RIDGE * np.eye(f.shape[1]), (f - mean).T @ ((target - level) * weight[:, None]))
    want = (f - mean) @ w + level
    _, got = model.margins([t for _, t in texts])
    assert model.languages == names and np.allclose(got, want, atol=2e-3)
    lang, score = model.predict([t for _, t in texts] + [LONG, None, "²"])
    assert lang[:40] == [name for name, _ in texts] and lang[-2:] == ["und", "und"] and (score[:40] > 0.5).all()


def test_leads_do_not_depend_on_the_number_of_languages():
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze"]
    x, _, _ = langid.presence([langid.normalised(t) for t in texts])
    model = langid.fit(np.packbits(x, axis=1), ["en", "fr", "de"])
    assert (model.lead([*texts, None, "½"]) > langid.LEAST_LEAD).tolist() == [True] * 3 + [False] * 2


# --- URL filter -----------------------------------------------------------------------------------------------------------


def _judge(url: str | None, rules) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/x?q#f", "http://www.example.com/en/", "https://a.b.net/es/1", "http://net/fr/", "http://notnet/es/", "http://x.com", "http://x.com?/en/", "x://y://example.com/en/", "http://example.com/EN/", "http://a.example.com/en/://z", "http://İ.com/", "http://com/" + "a/" * 5000, "http://" + "a." * 2000 + "net/es/", "http://example.com/en/x"]
    df = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate([*urls, urls[-1]])] + [(None, urls[-1], "h", "r", "v")], "page_id long, url string, host string, rule string, verdict string")
    rules = [*queries.URL_RULES, ("block", "com", "/" + "a/" * 3), ("allow", "EXAMPLE.com", "/e")]
    for given in (rules, spark.createDataFrame(rules, "verdict string, host string, path string")):
        got = urlfilter.judge(df, given, broadcast_rules=100 if given is rules else 0)
        lower = [(v, h.lower(), p) for v, h, p in rules]
        want = Counter((r.page_id, *_judge(r.url, lower)) for r in df.collect())
        assert Counter(tuple(r) for r in got.collect()) == want
    assert urlfilter.judge(df.where("false"), rules).count() == 0
    plan = urlfilter.judge(df, rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- language model -------------------------------------------------------------------------------------------------------

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _check_scores(got, docs, held) -> None:
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", t.translate(_LOWER)) + [0], held(d)) for d, t in docs]
    c = Counter(w for _, x, h in tokens if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = Counter((d, h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 5)) for d, x, h in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want


def _held(d) -> bool:
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def test_scores(spark, sf_dir, odd_documents, no_documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op9_bloom_filter_lm(spark, sf_dir).collect()
    _check_scores(got, texts_of(docs), _held)
    rate = lambda rows: sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert rate([r for r in got if not r.held_out]) > rate([r for r in got if r.held_out]) and all(r.score <= 0 for r in got)
    out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    _check_scores(bloomlm.score(odd_documents.repartition(2), out, filter_bits=1 << 14).collect(), texts_of(odd_documents), _held)
    assert bloomlm.score(no_documents, out).count() == 0
    nothing = bloomlm.score(odd_documents, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in nothing)


def test_scores_equal_interpolation_of_levels(spark):
    """Against exact counts in place of probes: levels from counts, read as the middle of their range."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = {i: " ".join(r.choices(vocabulary, range(60, 0, -1), k=r.randint(0, 80))) for i in range(120)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in bloomlm.score(df, F.col("doc_id") % 5 == 0, load=0.001).collect()}  # a load at which no probe passes by chance
    tokens = {i: [*t.split(), ""] for i, t in docs.items()}
    one = Counter(w for i, t in tokens.items() if i % 5 for w in t)
    # The token before a text's first is the end token.
    two = Counter((a, b) for i, t in tokens.items() if i % 5 for a, b in zip(["", *t], t, strict=False))
    middle = lambda n: math.floor(1.5 * 2 ** math.floor(math.log2(n))) if n else 0
    n, v = sum(one.values()), len(one)
    for i, t in tokens.items():
        want = 0.0
        for a, b in zip(["", *t], t, strict=False):
            c, cb, cab = middle(one[a]), middle(one[b]), middle(two[a, b])
            uni = (cb + 1) / (n + v + 1)
            want += math.log10(bloomlm.LAMBDA * min(cab, c) / c + (1 - bloomlm.LAMBDA) * uni if c else uni)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), i


def test_filter_reads_counts_back(spark):
    text = "a a a a b c c " * 40
    df = spark.createDataFrame([(text,)], "text string")
    model = bloomlm.train(df, buckets=128)
    t, _ = bloomlm.tokens([text.encode()])
    got = model.counts(np.unique(t), bloomlm.UNIGRAM)
    assert sorted(got.tolist()) == [1.0, 48.0, 96.0, 192.0]
    r = np.random.default_rng(0).integers(1, 2**63, 20_000).astype(np.uint64)
    assert (model.counts(r, bloomlm.BIGRAM) > 0).mean() < 0.01


def test_a_full_filter_keeps_the_frequent(spark):
    text = " ".join(f"w{i}" for i in range(3000)) + " x y" * 500
    model = bloomlm.train(spark.createDataFrame([(text,)], "text string"), buckets=128, filter_bits=1 << 15)
    t, _ = bloomlm.tokens([b"x y"])
    assert model.counts(bloomlm.bigrams(t), bloomlm.BIGRAM)[1] >= 256
    other = np.random.default_rng(0).integers(1, 2**63, 20_000).astype(np.uint64)
    assert (model.counts(other, bloomlm.BIGRAM) > 0).mean() < 0.12


def test_no_ngram_is_left_out(spark):
    """Far more n-grams than the least filter could hold: each is read back with the count of its level or a higher one."""
    words = [f"w{i}" for i in range(20_000)]
    text = " ".join(words + words[:100] * 3)
    model = bloomlm.train(spark.createDataFrame([(text,)], "text string"), buckets=128, filter_bits=1 << 15)
    t, _ = bloomlm.tokens([text.encode()])
    for kind, x in ((bloomlm.UNIGRAM, t), (bloomlm.BIGRAM, bloomlm.bigrams(t))):
        key, n, _ = bloomlm.counted(x, np.ones(len(x), np.int64))
        assert (model.counts(key, kind) >= np.floor(1.5 * 2.0 ** (bloomlm.level_of(n) - 1))).all()
    other = np.random.default_rng(0).integers(1, 2**63, 20_000).astype(np.uint64)
    assert (model.counts(other, bloomlm.BIGRAM) > 0).mean() < 0.12


# --- WebP -----------------------------------------------------------------------------------------------------------------

_R = np.random.default_rng(0)


def _image(kind: str, h: int, w: int) -> np.ndarray:
    few = np.array([[1, 2, 3, 255], [9, 8, 7, 255], [200, 1, 30, 128], [0, 0, 0, 0], [5, 5, 5, 5], [6, 7, 8, 9]])
    made = {"noise": lambda: _R.integers(0, 256, (h, w, 4)), "few": lambda: few[_R.integers(0, 6, (h, w))], "smooth": lambda: np.stack([np.add.outer(np.arange(h) * 3, np.arange(w) * 2 + k) % 256 for k in range(4)], 2), "two": lambda: few[_R.integers(0, 2, (h, w))], "flat": lambda: np.full((h, w, 4), 77)}
    return made[kind]().astype(np.uint8)


@pytest.mark.parametrize("kind", ["noise", "few", "smooth", "two", "flat"])
@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 0), (0, 1, 2), (3, 0)])
def test_images(kind, transforms):
    for h, w in ((1, 1), (3, 5), (17, 13)):
        if 3 in transforms and kind in ("noise", "smooth") and h * w > 200:
            continue
        image = _image(kind, h, w)
        for cache, references in ((0, False), (4, False), (0, True), (7, True)):
            data = webp.encode(image, transforms, cache_bits=cache, references=references, block=2)
            assert (webp.decode(data) == image).all()


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7)


def test_payloads():
    pay = [bytes(_R.integers(0, 256, 64 * k, dtype=np.uint8)) for k in (1, 2, 127, 128, 129, 300)] + [b"\0" * 64, b"a" * 64 + b"\0" * 64, b"ab" * 32, (b"hello world " * 500)[: 64 * 70]]
    media = webp.store(pay)
    assert [x.tobytes() for x in webp.load(media)] == pay
    assert webp.store(pay[::-1]) == media[::-1]
    for p, m in zip(pay, media, strict=True):
        if len(p) <= webp.TILE:
            assert webp.decode(m)[:, :, 1].tobytes() == p
    other = webp.encode(_image("few", 4, 64), (2,), references=True)
    assert (webp.load([other])[0] == webp.decode(other)[:, :, 1].ravel()).all()
    for broken in (media[0][:30], media[0][:-20], b"RIFFxxxx", b""):
        if broken:
            with pytest.raises(ValueError):
                webp.load([broken])


def test_what_the_encoder_chooses():
    """Back-references, palettes and predictors where they save bytes, each inverted by the vectorised reader and by decode."""
    line = "the same line again, and no other than that one; "
    made = {
        webp.PLAIN: (line * 90 + " ".join(f"{i * 7919 % 10_007}" for i in range(500))).encode(), webp.PALETTED: b"0110" * 64, webp.FROM_LEFT: bytes((i * i // 7 + j * 3) % 256 for i in range(60) for j in range(64)),
        webp.FROM_TOP: (columns := bytes(_R.integers(0, 256, 64, dtype=np.uint8))) + b"".join(bytes((x + 5 * k) % 256 for x in columns) for k in range(1, 60)),
    }
    pay = [x + b"\0" * (-len(x) % 64) for x in made.values()]
    media = webp.store(pay)
    assert [x.tobytes() for x in webp.load(media)] == pay
    for kind, p, m in zip(made, pay, media, strict=True):
        images = webp.images_of(m)
        assert [webp._plan(x).kind for x in images] == [kind] * len(images)
        assert b"".join(webp.decode(webp._file(x))[:, :, 1].tobytes() for x in images) == p
        assert len(m) < len(p) * (0.3 if kind == webp.PLAIN else 0.6)
    long = (line * 2000).encode()
    assert len(webp.images_of(webp.store([long + b"\0" * (-len(long) % 64)])[0])) == -(-len(long) // webp.TILE)
    place, length, far = webp._copies(np.frombuffer(pay[0][:4096], np.uint8), np.zeros(4096, np.int64), np.array([4096]))
    assert length.sum() > 3000 and (far <= place).all() and all(pay[0][p : p + n] == (pay[0][p - d : p] * (n // d + 1))[:n] for p, n, d in zip(place, length, far, strict=True))


def test_other_images_go_through_the_general_decoder():
    """Images with a colour cache, cross-colour or other predictors, as another writer makes them."""
    image = np.repeat(_R.integers(60, 70, (5, 64, 1)), 3, 2).astype(np.uint8)
    image = np.concatenate([image, np.full((5, 64, 1), 255, np.uint8)], 2)
    for transforms, cache in (((), 5), ((1,), 0), ((0,), 0), ((0, 1, 2), 4), ((2, 0), 0)):
        data = webp.encode(image, transforms, cache_bits=cache, references=True, block=2)
        assert (webp.load([data, data])[1] == image[:, :, 1].ravel()).all()


def test_media_query(spark, sf_dir, odd_documents, no_documents):
    for docs, got in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.op10_lossless_webp(spark, sf_dir)), (odd_documents, webp.round_trip(odd_documents))):
        want = Counter()
        for d, t in texts_of(docs):
            b = t.encode()
            p = b + b"\0" * (-len(b) % 64 if b else 64)
            want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
        rows = got.collect()
        assert Counter(tuple(r)[:5] for r in rows) == want
        assert len({(r.payload_sha256, r.n_bytes) for r in rows}) == len({(r.payload_sha256, r.n_bytes, r.media_sha256, r.media_bytes, r.feature) for r in rows})
    assert webp.round_trip(no_documents).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, odd_documents, no_documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "substring dedup", "packing"] and "pipeline" in entry.queries()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        whole = stage(spark, whole, sf_dir)
        assert whole.columns == docs.columns
    tokens = corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0]
    assert tokens == packing.pack_documents(whole).agg(F.sum("length")).first()[0]
    for start in (odd_documents, no_documents):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir)
        assert (now.count() == 0) == (start is no_documents)


def test_the_language_that_is_identified_shapes_the_packing(spark, sf_dir):
    """Wrong and missing labels of held-out documents: the stage mends them, and no sequence holds two languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 300")
    right = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    wrong = docs.withColumn("lang", F.when(~langid.held_out(), F.col("lang")).when(F.col("doc_id") % 2 == 0, "xx"))
    named = corpus_pipeline.language_id(spark, wrong, sf_dir)
    got = {r.doc_id: r.lang for r in named.select("doc_id", "lang").collect()}
    assert got.keys() == right.keys() and sum(got[k] == right[k] for k in got) / len(got) > 0.95
    known = {r.doc_id: r.lang_pred for r in langid.identify(wrong).collect()}
    assert got == known
    pieces = corpus_pipeline.pack(spark, named, sf_dir).collect()
    assert {(r.doc_id, r.lang) for r in pieces} == set(got.items()) and len(set(got.values())) > 1
    assert len({(r.sequence_id, r.lang) for r in pieces}) == len({r.sequence_id for r in pieces})


def test_packing_by_a_column_loses_nothing(spark, odd_documents, no_documents):
    plain = lambda df: sorted(((r.doc_id or 0, r.doc_tokens, i) for r in df.collect() for i in range(r.start, r.start + r.length)))
    for block in (50, 1_000_000):
        pieces = packing.pack_documents(odd_documents.repartition(2), block_tokens=block, by="lang")
        assert plain(pieces) == plain(packing.pack_documents(odd_documents))
        full: dict = {}
        for r in pieces.collect():
            full.setdefault((r.sequence_id, r.window, r.lang), []).append((r.offset, r.length))
        assert len(full) == len({k[0] for k in full}) and {k[2] for k in full} == {"en", "fr", "es", "ja", None}
        for (_, window, _), held in full.items():
            assert [at for at, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))] and sum(n for _, n in held) == window
    assert packing.pack_documents(no_documents, by="lang").count() == 0
