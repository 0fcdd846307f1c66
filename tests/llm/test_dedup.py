"""Operators 5 and 7 against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import OTHER, SHARED, THIRD, texts_of
from tributary.llm import cdc, probminhash, queries


def shingle_set(text: str) -> set:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(docs: dict[int, str], least: float = 0.8) -> dict[int, int]:
    sets = {k: shingle_set(v) for k, v in docs.items()}
    parent = {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            where[x].add(k)
    by_text = defaultdict(list)
    for k, v in docs.items():
        by_text[v].append(k)
    links = [(min(v), k) for v in by_text.values() for k in v]
    for k, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for o in where[x]:
                both[o] += 1
        links += [(o, k) for o, n in both.items() if o < k and n >= least * (len(s) + len(sets[o]) - n)]
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in docs}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_classes_equal_brute_force(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    docs = dict(texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert {r.doc_id: r.class_id for r in queries.op7_probminhash_classes(spark, sf_dir).collect()} == brute_classes(docs)


def test_a_group_that_only_chains_hold_together(spark):
    """Copies with a few changed words each: most pairs are below the similarity, the class hangs together by some."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [r.choice(vocabulary) for _ in range(150)]
    docs = {}
    for i in range(260):
        copy = list(base)
        for at in r.sample(range(150), r.randint(1, 7)):
            copy[at] = r.choice(vocabulary)
        docs[i] = " ".join(copy)
    for i in range(260, 300):
        docs[i] = " ".join(r.choice(vocabulary) for _ in range(100))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = brute_classes(docs)
    for limit in (probminhash.LIMIT, 10):
        assert {x.doc_id: x.class_id for x in probminhash.classes(df, limit=limit).collect()} == want


def test_odd_documents_have_classes(odd_documents, no_documents):
    got = sorted(tuple(r) for r in probminhash.classes(odd_documents).select("doc_id", "class_id").distinct().collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (8, 8), (9, 9), (11, 11), (12, 12), (13, 13)]
    kept = probminhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), *((True, i) for i in (1, 2, 3, 4, 5, 8, 9, 11, 11, 12, 13))]
    assert {r.text for r in kept.where("doc_id = 11").collect()} == {SHARED, OTHER}
    assert probminhash.classes(no_documents).count() == 0 and probminhash.keep_one(no_documents).count() == 0


def test_large_buckets_are_compared_exactly(spark):
    """Pairs of near-duplicates that share a single large bucket, with a passage that all texts have."""
    r = random.Random(6)
    docs = {}
    common = [f"c{i}" for i in range(40)]
    for i in range(0, 60, 2):
        own = [f"w{i}x{j}" for j in range(60)]
        docs[i], docs[i + 1] = " ".join(common + own), " ".join(common + own[: r.randint(52, 58)])
    df = spark.createDataFrame(list(docs.items()), "rep long, text string")
    sets = probminhash._sets(df).cache()
    members = df.select(F.lit(1).alias("key"), "rep", F.size(F.split("text", " ")).cast("long").alias("n"), F.col("rep").alias("comp")).select("key", "rep", (F.col("n") - 4).alias("size"), "comp")
    got = {tuple(sorted(x)) for x in probminhash._rest(members, sets, 0.8, limit=10).collect()}
    assert got == {(i, i + 1) for i in range(0, 60, 2)}


def test_a_large_bucket_with_few_texts_left_over_is_compared_directly(spark, monkeypatch):
    """80 texts of one component and 3 others, of which one is near to it: 249 pairs, so nothing is dealt by prefixes at 20 x 20."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    docs = {i: " ".join([*base, f"x{i}"]) for i in range(80)} | {80: " ".join(base[:76]), 81: " ".join(f"y{i}" for i in range(60)), 82: " ".join(r.sample(base, 80))}
    sets = probminhash._sets(spark.createDataFrame(list(docs.items()), "rep long, text string")).cache()
    size = {x.rep: len(x.set) // 6 for x in sets.collect()}
    members = spark.createDataFrame([(1, i, size[i], 0 if i < 80 else i) for i in docs], "key long, rep long, size long, comp long")
    dealt = []
    real = probminhash._prefixes
    monkeypatch.setattr(probminhash, "_prefixes", lambda texts, *rest: dealt.append(texts.count()) or real(texts, *rest))
    assert {tuple(sorted(x)) for x in probminhash._rest(members, sets, 0.8, limit=20).collect()} == {(0, 80)}
    assert dealt == [0]
    assert {tuple(sorted(x)) for x in probminhash._rest(members, sets, 0.8, limit=15).collect()} == {(0, 80)}
    assert dealt == [0, 83]


def test_of_buckets_of_the_same_texts_one_is_kept(spark):
    held = {1: [5, 6], 2: [6, 5], 3: [5, 6, 7], 4: [8], 5: [6, 7], 6: [5, 6, 7], 7: [5, 7]}
    every = spark.createDataFrame([(k, x) for k, xs in held.items() for x in xs], "key long, rep long").repartition(3)
    assert sorted(x.key for x in probminhash._different(every).collect()) == [1, 3, 5, 7]


def test_signatures_estimate_weighted_similarity():
    """Agreement of registers against the probability Jaccard similarity, computed from its definition."""
    r = np.random.default_rng(3)
    elements = r.integers(1, 2**48, 60).astype(np.uint64)
    a, b = r.random(60) * (r.random(60) < 0.8), r.random(60) * (r.random(60) < 0.8)
    text = np.repeat([0, 1], 60)
    keep = np.concatenate([a, b]) > 0
    sig = probminhash.signatures(2, text[keep], np.concatenate([elements, elements])[keep], np.concatenate([a, b])[keep], 4000)
    want = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in range(60)) for i in range(60) if a[i] and b[i])
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_band_recall():
    """Texts of similarity 0.8 share a bucket with probability 0.9999."""
    assert 1 - (1 - 0.8**probminhash.ROWS) ** probminhash.BANDS > 0.9999


def test_band_recall_with_repeated_lines(spark):
    """Similar texts of which one has a line fifty times: bands follow the similarity of sets, which verification counts."""
    r = random.Random(12)
    some = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    docs = {}
    for i in range(0, 600, 2):
        line, base = some(20), some(90)
        docs[i], docs[i + 1] = " ".join(base + line * 50), " ".join(some(5) + base[5:] + line)
        a, b = shingle_set(docs[i]), shingle_set(docs[i + 1])
        assert 0.8 <= len(a & b) / len(a | b) < 0.9
    keys = {x.doc_id: set(x.bands) for x in probminhash._scan(probminhash._source(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text")).collect()}
    assert sum(not keys[i] & keys[i + 1] for i in range(0, 600, 2)) <= 2


def test_repeated_passages_are_found_and_others_left(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(4000)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs, planted = {}, set()
    for i in range(40):
        passage = some(51)
        for d in (2 * i, 2 * i + 1):
            docs[d] = f"{some(r.randint(0, 90))} {passage} {some(r.randint(0, 90))}".strip()
            planted.add(d)
    for i in range(80, 160):
        docs[i] = some(r.randint(1, 200))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = cdc.repeated_passages(df).collect()
    assert {x.doc_id for x in got} == planted
    assert all(x.removed_words == (0 if x.doc_id % 2 == 0 else x.words) for x in got)
    left = dict(texts_of(cdc.dedup(df)))
    assert all(left[k] == v for k, v in docs.items() if k not in planted or k % 2 == 0)
    for k in range(1, 80, 2):
        assert len(docs[k]) - len(left[k]) > 80 and set(left[k].split()) <= set(docs[k].split())


def test_every_long_repeat_of_the_corpus(spark, sf_dir):
    docs = dict(texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    seen = defaultdict(set)
    for k, v in docs.items():
        w = v.split()
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(k)
    want = {k for s in seen.values() if len(s) > 1 for k in s}
    assert want <= {r.doc_id for r in queries.op5_gear_chunk_dedup(spark, sf_dir).collect()}


def test_chunks_do_not_depend_on_the_batch():
    r = random.Random(4)
    texts = [" ".join(r.choice(["ab", "c", "defgh", "x" * 90, "é"]) for _ in range(r.randint(0, 60))).encode() for _ in range(30)] + [b"", b"  ", "漢字仮名".encode() * 200]
    every = cdc.chunk_texts(texts)
    for i, t in enumerate(texts):
        alone, mine = cdc.chunk_texts([t]), every[0] == i
        for a, b in zip(alone[1:], every[1:], strict=True):
            assert (a == b[mine]).all()
        for s, e in zip(alone[2], alone[3], strict=True):
            assert t[s:e].strip() == t[s:e]
            t[s:e].decode()


def test_gear_hash_is_rolling():
    data = np.random.default_rng(0).integers(0, 256, 300).astype(np.uint8)
    h, full = 0, cdc.gear(data)
    for i, b in enumerate(data.tolist()):
        h = (2 * h + int(cdc.GEAR[b])) % 2**32
        assert int(full[i]) == h


def test_insertions_do_not_shift_chunks():
    r = random.Random(8)
    text = " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(400))
    a, b = (set(cdc.chunk_texts([t.encode()])[5].tolist()) for t in (text, "one two three " + text))
    assert len(a & b) >= len(a) - 4


def test_odd_documents_are_deduplicated(odd_documents, no_documents):
    got = cdc.dedup(odd_documents)
    assert got.columns == odd_documents.columns and got.schema["text"].dataType == odd_documents.schema["text"].dataType
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in got.collect())
    assert ids == sorted((r.doc_id is not None, r.doc_id or 0) for r in odd_documents.collect())
    assert {r.text for r in got.where("doc_id = 11").collect()} == {SHARED, OTHER}
    cut = got.where("doc_id = 12").first().text
    assert cut.startswith("autre0 ") and len(cut) < len(THIRD) - 150 and set(cut.split()) <= set(THIRD.split())
    long = [r.text for r in got.where("doc_id = 5").collect()][0]
    assert long.endswith("fin") and len(long) < 54_000
    assert cdc.dedup(no_documents).count() == 0 and cdc.repeated_passages(no_documents).count() == 0


def test_texts_that_vanish_go(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cdc.dedup(df).collect()) == [1, 3]


@pytest.mark.parametrize("share", [0.34])
def test_hot_groups(spark, share):
    """A third of all rows in one group of copies."""
    n = 3000
    df = spark.range(n, numPartitions=6).select(F.col("id").alias("doc_id"), F.when(F.col("id") < int(n * share), "a b c d e f g h i j k l m n o p q r s t u v").otherwise(F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(k))) for k in "abcdef"])).alias("text"))
    got = probminhash.classes(df).groupBy("class_id").count().orderBy(F.desc("count")).limit(2).collect()
    assert [r["count"] for r in got] == [int(n * share), 1]
    assert cdc.dedup(df).count() == n - int(n * share) + 1


def test_a_lone_text_under_a_shared_id_is_left_alone(spark):
    """Places found in one text never cut another text of the same doc_id."""
    r = random.Random(3)
    some = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, alone = some(60), some(90)
    df = spark.createDataFrame([(1, passage + " " + some(9)), (2, some(20) + " " + passage), (2, alone), (2, "é" * 50 + alone[:40])], "doc_id long, text string")
    left = [x.text for x in cdc.dedup(df).where("doc_id = 2").collect()]
    assert alone in left and "é" * 50 + alone[:40] in left and len(left) == 3 and min(map(len, left)) < 300


def test_reported_passages_do_repeat(spark, sf_dir):
    """Every reported passage's inner words occur in another text too, or twice in its own."""
    docs = dict(texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    seen = defaultdict(int)
    for v in docs.values():
        w = v.split()
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])] += 1
    wrong = []
    for x in cdc.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        w = docs[x.doc_id].encode()[x.start : x.end].decode().split()
        assert len(w) == x.words
        if len(w) >= 9:
            wrong.append(sum(seen[tuple(w[i : i + 5])] > 1 for i in range(len(w) - 4)) < 0.5 * (len(w) - 4))
    assert wrong and sum(wrong) <= 0.02 * len(wrong)
