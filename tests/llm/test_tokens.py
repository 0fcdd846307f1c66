"""Operators 1, 2 and 6: token ids equal the library's; packing and files keep every id."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import texts_of
from tributary.llm import bpe_trie, packing, queries, rans, tokens

PIECES = [*"abstremvld'''   \n\t\r  AZé ñßµª²½0129.,!?-—€’ ", "'s", "'re", "'ll", "'ve", " '", "\u3000", "中", "\0", "<|endoftext|>", "\u2028", "🙂", "\u00a0", "\u0301"]


@pytest.mark.parametrize("kind", [tokens.Encoder, bpe_trie.TrieEncoder])
def test_ids_equal_the_library(library, kind):
    r, coder = random.Random(3), kind(tokens.vocabulary(), cache_bytes=20_000)
    for k in range(300):
        safe = PIECES[:44] if k % 3 else PIECES
        batch = ["".join(r.choice(safe) for _ in range(r.randint(0, 40))) for _ in range(20)] + [None, "", "\0", "'s", "\n", "a" * 300, "é" * 300]
        ids, counts = coder.encode(batch)
        at = 0
        for text, n in zip(batch, counts, strict=True):
            assert ids[at : at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
            at += n


def test_other_vocabularies():
    """One with a normaliser and another rule for pre-tokens: texts go to the library whole, and the trie refuses it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other, coder = Tokenizer.from_file(path), tokens.Encoder(tokens.vocabulary(path=path))
    texts = ["Hello  World, it's 2024!", "ÉCOLE\n\tx", "", "don't <|endoftext|> stop"]
    ids, counts = coder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in other.encode(t, add_special_tokens=False).ids] and len(counts) == 4
    with pytest.raises(ValueError):
        bpe_trie.TrieEncoder(tokens.vocabulary(path=path))


def test_trie_on_vocabulary_and_random_bytes(library):
    vocab = bpe_trie.Vocabulary(tokens.vocabulary())
    r = random.Random(1)
    words = ["".join(r.choice("aeiounrstl") for _ in range(r.randint(1, 30))) for _ in range(2000)] + ["ab" * 40, "aaaa" * 50]
    got = vocab.encode_words([w.encode() for w in words])
    for w in words:
        assert got[w.encode()] == library.encode(w, add_special_tokens=False).ids
        assert bpe_trie.decode(got[w.encode()], tokens.vocabulary()) == w


def _ids(library, text, end):
    return np.array([*library.encode(text, add_special_tokens=False).ids, end], np.uint32)


def _check_packing(pieces, want):
    """want: doc_id -> list of arrays of ids (one for each row of that id)."""
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert by.keys() == want.keys()
    for doc, parts in by.items():
        got = Counter((p.start, p.length, p.ids_crc32) for p in parts)
        assert sum(p.length for p in parts) == sum(map(len, want[doc]))
        for p in parts:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length]) == p.ids_crc32 for x in want[doc])
        if len(want[doc]) == 1:
            at = 0
            for s, n, _ in sorted(got):
                assert s == at
                at += n
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == parts[0].window <= 1024


def test_packing(spark, sf_dir, library):
    got = queries.op1_hierarchical_packing(spark, sf_dir)
    want = defaultdict(list)
    for doc, text in texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want[doc].append(_ids(library, text, 0))
    _check_packing(got.collect(), want)
    total = packing.padding(got).first()
    assert total.padding == 0 and total.tokens == sum(len(x) for v in want.values() for x in v)
    steps = got.groupBy("step_group", "window").agg({"length": "sum"}).collect()
    big = [r["sum(length)"] for r in steps if r["window"] == 1024]
    assert max(big) - min(big) <= 1024


def test_packing_of_odd_documents(odd_documents, no_documents, library):
    want = defaultdict(list)
    for doc, text in texts_of(odd_documents):
        want[doc].append(_ids(library, text, 0))
    _check_packing(packing.pack_documents(odd_documents.repartition(2), block_tokens=50).collect(), want)
    assert packing.pack_documents(no_documents).count() == 0


def test_packer_fills_windows_from_shorter_tiers():
    r = random.Random(2)
    for _ in range(200):
        lengths = [r.choice([r.randint(1, 50), r.randint(1, 3000)]) for _ in range(r.randint(0, 30))]
        windows, left = packing.pack_lengths([], lengths, last=True)
        assert not left
        cover = defaultdict(list)
        for size, pieces in windows:
            assert sum(n for _, _, n in pieces) == size and (size & (size - 1)) == 0
            for doc, start, n in pieces:
                cover[doc].append((start, n))
        for doc, n in enumerate(lengths):
            at = 0
            for s, k in sorted(cover[doc]):
                assert s == at
                at += k
            assert at == n


def test_step_groups_balance():
    windows = [(1024, [(0, 0, 1024)])] * 10 + [(512, [(0, 0, 256), (1, 0, 256)])] * 7
    groups = packing.step_groups(windows, 2048)
    sizes = Counter()
    for (size, _), g in zip(windows, groups, strict=True):
        sizes[size, g] += 1
    assert {v for (s, _), v in sizes.items() if s == 1024} == {2} and max(v for (s, _), v in sizes.items() if s == 512) <= 4


@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 129, 65_536, 65_537, 200_000])
def test_frames(n):
    x = np.minimum(np.random.default_rng(n).zipf(1.2, n), 50_256).astype(np.uint32)
    frame = rans.encode_frame(x)
    assert (rans.decode_frame(frame) == x).all()
    if n:
        for at in (len(frame) - 1, len(frame) // 2):
            broken = bytearray(frame)
            broken[at] ^= 4
            with pytest.raises(ValueError):
                rans.decode_frame(bytes(broken))


def test_frames_are_near_the_entropy():
    x = np.minimum(np.random.default_rng(0).zipf(1.15, 2_000_000), 50_256).astype(np.uint32)
    p = np.bincount(x) / len(x)
    p = p[p > 0]
    assert len(rans.encode_frame(x)) * 8 / len(x) < 1.07 * -(p * np.log2(p)).sum()


def test_frequencies():
    for counts in ([1], [10**9, 1, 1], [1] * 1000, [5, 0, 7]):
        f = rans.normalise(np.array(counts))
        assert f.sum() == 1 << rans.PRECISION and ((f > 0) == (np.array(counts) > 0)).all()


def test_files(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op2_rans_token_files(spark, sf_dir).collect()}
    at = 0
    for doc, text in sorted(texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        x = _ids(library, text, 2)
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(x), zlib.crc32(x))
        at += len(x)


def test_files_of_odd_documents(odd_documents, no_documents, library):
    got = rans.round_trip(odd_documents.repartition(3), segment_tokens=1000).orderBy("start").collect()
    want = sorted(((d is not None, d or 0), zlib.crc32(_ids(library, t, 2))) for d, t in texts_of(odd_documents))
    assert [((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert rans.round_trip(no_documents).count() == 0


def test_trie_query(spark, sf_dir, library, odd_documents, no_documents):
    def check(got, docs):
        want = Counter()
        for doc, text in texts_of(docs):
            ids = library.encode(text, add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want[doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert Counter(tuple(r)[:4] for r in got.collect()) == want

    check(queries.op6_trie_bpe(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check(bpe_trie.encode_documents(odd_documents, with_ids=True), odd_documents)
    for r in bpe_trie.encode_documents(odd_documents, with_ids=True).collect():
        assert len(r.ids) == r.n_tokens and bpe_trie.decode(r.ids, tokens.vocabulary()) == r.decoded
    assert bpe_trie.encode_documents(no_documents).count() == 0
