"""Byte-level BPE by prefix-sharing trie traversal, and its decoding (operator 6).

The last token of a text's encoding, together with those of its prefixes, determines the encoding: the last token of a prefix
is the longest vocabulary entry that ends it and that BPE would leave beside the last token of what precedes it.  So the
distinct words of a batch are visited depth first in trie order (sorted order; the path to the current word is a stack) and
only the last-token state of each new trie node is computed; prefixes that words share are computed once.

Words are collected for one batch at a time and their encodings kept in a bounded cache, so memory doesn't grow with the data;
the plan is a scan and one Arrow map.

Edge cases: a null text is encoded as an empty one (no ids, empty decoded text); null ids stay null; repeated rows give a row
each; texts may be of any length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_and_text, slices
from .tokens import TOKEN_SLICE, Encoder, vocabulary


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: a printable byte stands for itself,
    the others get the characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, the merges that make them, and which two tokens BPE leaves side by side."""

    def __init__(self, source: str):
        data = json.loads(source)
        symbols = byte_symbols()
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        names = {k: v for k, v in data["model"]["vocab"].items() if k not in self.special}
        self.bytes = {i: bytes(map(symbols.__getitem__, name)) for name, i in names.items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        #: Every ending of a token: the token it is itself, else -1.
        self.endings = {b[i:]: -1 for b in self.ids for i in range(len(b))} | self.ids
        self.decimal = {i: str(i) for i in (*self.bytes, *self.special.values())}
        self.bytes |= {i: name.encode() for name, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # token: left half, right half, rank of their merge
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = names[left], names[right], names[left + right]
            self.rank[a, b] = rank
            self.halves.setdefault(made, (a, b, rank))
        self.adjacent: dict[int, bool] = {}  # by left << 20 | right

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE, on the two tokens' bytes together, makes just these two: at no time is a merge across the border due.

        The tokens are taken apart in the reverse order of the merges that built them; what faces the border then must
        not merge earlier than the part that was made last."""
        known = self.adjacent.get(left << 20 | right)
        if known is not None:
            return known
        a, b, answer = left, right, True
        due, strict = len(self.rank), True  # a merge across the border counts if its rank is below due, or equal and not strict
        while True:
            across = self.rank.get((a, b))
            if across is not None and (across < due or across == due and not strict):
                answer = False
                break
            x, y = self.halves.get(a), self.halves.get(b)
            if x is None and y is None:
                break
            # Undo the later merge; of two occurrences of the same merge the left one is made first, so the right is undone first.
            if y is None or x is not None and x[2] > y[2]:
                due, strict, a = x[2], True, x[1]
            else:
                due, strict, b = y[2], False, y[0]
        if len(self.adjacent) > 1_000_000:
            self.adjacent.clear()
        self.adjacent[left << 20 | right] = answer
        return answer

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The encoding of each word, by one depth-first visit of their trie."""
        endings, stays, known, size = self.endings, self.stays, self.adjacent, self.bytes
        out: dict[bytes, list[int]] = {}
        path: list[int] = [-1]  # path[i]: last token of the current word's prefix of i bytes
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # Vocabulary entries that end here, from the shortest on; the longest one that may stand here is kept.
                fits: list[tuple[int, int]] = []
                for start in range(end - 1, -1, -1):
                    token = endings.get(word[start:end])
                    if token is None:
                        break
                    if token >= 0:
                        fits.append((start, token))
                for start, token in reversed(fits):
                    if not start:
                        break
                    left = path[start]
                    stay = known.get(left << 20 | token)
                    if stay if stay is not None else stays(left, token):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                path.append(token)
            at, made = len(word), []
            while at:
                made.append(path[at])
                at -= len(size[path[at]])
            out[word] = made[::-1]
            before = word
        return out


@lru_cache(2)
def _vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


class TrieEncoder(Encoder):
    """As Encoder, with encodings by the trie; the library only splits texts with unusual characters into pre-tokens.

    For byte-level vocabularies without a normaliser and without marks at the ends of words; others are refused."""

    def __init__(self, vocab: str, cache_bytes: int = 100_000_000):
        spec = json.loads(vocab)
        model = spec["model"]
        if model.get("type") != "BPE" or spec.get("normalizer") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or "ByteLevel" not in json.dumps(spec.get("pre_tokenizer")):
            raise ValueError("not a byte-level BPE vocabulary without a normaliser")
        self.vocab = _vocabulary(vocab)
        super().__init__(vocab, cache_bytes)

    def _clear(self) -> None:
        super()._clear()
        self.listed: list[str] = []  # a word's ids in decimal, joined by commas
        self.decoded: list[bytes] = []

    def _trim(self) -> np.ndarray:
        listed, decoded = self.listed, self.decoded
        keep = super()._trim()
        self.listed, self.decoded = [listed[i] for i in keep.tolist()], [decoded[i] for i in keep.tolist()]
        return keep

    def _whole(self, text: str) -> list[str]:
        at, out = 0, []
        for m in self.special.finditer(text) if self.special else ():
            out += [*self._split(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def _ids(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        vocab = self.vocab
        made = vocab.encode_words([w.encode() for w in words if w not in vocab.special])
        lists = [[vocab.special[w]] if w in vocab.special else made[w.encode()] for w in words]
        self.listed += [",".join(map(vocab.decimal.__getitem__, x)) for x in lists]
        self.decoded += [b"".join(map(vocab.bytes.__getitem__, x)) for x in lists]
        self.held += sum(map(len, words)) + 300 * len(words)
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(lens.sum())), lens


@lru_cache(1)
def _encoder(vocab: str) -> TrieEncoder:
    return TrieEncoder(vocab)


def decode(ids: list[int], vocab: str) -> str:
    """The text of these ids, special tokens included."""
    return b"".join(map(_vocabulary(vocab).bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text and, if ``with_ids``, the ids and the decoded text."""
    source = id_and_text(docs, id_col, text_col)
    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]
    sent = docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for a, b in slices(batch.column(1), TOKEN_SLICE):
                part = batch.slice(a, b - a)
                codes, counts = encoder.codes(part.column(1).to_pylist())
                edges, sizes = np.concatenate([[0], np.cumsum(counts)]).tolist(), encoder.place[1, codes]
                upto = np.concatenate([[0], np.cumsum(sizes)])[edges]
                each = codes.tolist()
                listed, decoded = list(map(encoder.listed.__getitem__, each)), list(map(encoder.decoded.__getitem__, each))
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                texts = [b"".join(decoded[i:j]).decode("utf-8", "replace").encode() for i, j in spans]
                cols = [part.column(0), pa.array(np.diff(upto)), pa.array([sha(",".join(listed[i:j]).encode()) for i, j in spans]), pa.array(list(map(sha, texts)))]
                if with_ids:
                    first = encoder.place[0, codes]
                    ids = encoder.flat[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(upto[-1])]
                    cols += [pa.ListArray.from_arrays(upto.astype(np.int32), pa.array(ids.astype(np.int32))), pa.array([t.decode() for t in texts])]
                yield pa.RecordBatch.from_arrays(cols, names)

    return source.mapInArrow(run, T.StructType(fields))
