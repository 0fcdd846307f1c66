"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of pre-token encodings.

A byte-level BPE encodes each pre-token on its own.  Texts are split into pre-tokens by vector operations on their bytes,
Arrow numbers the distinct ones of a slice, and the library is asked once for each that is not in the cache; a text's ids are
then gathered by number.  Texts with characters outside a range in which Unicode classes have long been stable, or with a
special token's string, and all texts if the vocabulary has another rule for pre-tokens or a normaliser, are given to the library
whole; both ways give the library's own ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Bytes of text that are split and looked up at once: distinct pre-tokens are fewer in larger slices.
TOKEN_SLICE = 4_000_000
STABLE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞₠-₿]*")
#: Classes of characters: other, letter, number, white space (the space itself being one), end of a text.
OTHER, LETTER, NUMBER, WHITE, END = range(5)


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x250)], np.uint8)
    table[[0x09, 0x0A, 0x0D, 0x20]] = WHITE
    table[0] = END
    return table


CLASSES = _classes()
_BYTES = np.concatenate([CLASSES[:128], np.full(128, OTHER, np.uint8)])


def boundaries(buf: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in a buffer of stable UTF-8 texts that each end in a zero byte (which is one by itself).

    The rule: one of the contractions 's 't 're 've 'm 'll 'd; or a run of letters, of numbers or of other characters, with the
    space before it if there is one; or white space, whose last character stays apart if more text follows."""
    kind = _BYTES[buf]
    wide = np.flatnonzero(buf >= 0xC0)
    if len(wide):
        two = wide[buf[wide] < 0xE0]
        kind[two] = kind[two + 1] = CLASSES[(buf[two].astype(np.int64) & 0x1F) << 6 | buf[two + 1] & 0x3F]
    before = np.concatenate([[END], kind[:-1]])
    start = kind != before
    white = kind == WHITE
    # The last character of white space before more text: apart from the rest, and joined to the text if it is a space.
    turn = np.flatnonzero(white[:-1] & (kind[1:] != WHITE) & (kind[1:] != END))
    start[turn] = True
    start[turn[buf[turn] == 0x20] + 1] = False
    start[kind == END] = True
    start[np.flatnonzero(kind[:-1] == END) + 1] = True
    # Contractions.
    at = np.flatnonzero((buf == 0x27) & start)
    if len(at):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        for hit, size in ((at[short], 2), (at[long & ~short], 3)):
            start[hit + 1] = False
            start[np.minimum(hit + size, len(start) - 1)] = True
    return np.flatnonzero(start)


def vocabulary(name: str = "byte_bpe_50k.json", path: str | None = None) -> str:
    """The vocabulary file's content, read on the driver (a few MB whatever the data's size) and sent to workers by broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """encode(texts) -> (ids of all texts one after another, number of ids of each text)."""

    def __init__(self, vocab: str, cache_bytes: int = 50_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Python worker has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocab)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(vocab)
        added = [x["content"] for x in spec.get("added_tokens", [])]
        # ``boundaries`` knows one rule; texts of vocabularies with another one go to the library whole.
        rule = spec.get("pre_tokenizer") or {}
        self.own_rule = not spec.get("normalizer") and rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and rule.get("use_regex", True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.cache_bytes = cache_bytes
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.held = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.place = np.zeros((2, 1 << 14), np.int64)  # start and length in flat, by code
        self.uses = np.zeros(1 << 14, np.int32)  # slices that had the word since the cache was last trimmed, by code
        self.used = 0

    def _trim(self) -> np.ndarray:
        """Keep the words that more than one slice had, unless those are most of the cache; returns their former codes."""
        n = len(self.code)
        keep = np.flatnonzero(self.uses[:n] > 1)
        if 2 * len(keep) > n:
            keep = keep[:0]
        words, start, lens = list(self.code), self.place[0, keep], self.place[1, keep]
        flat = self.flat[np.repeat(start - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
        held = self.held * len(keep) // max(1, n)
        self._clear()
        self.code = {words[i]: k for k, i in enumerate(keep.tolist())}
        self._room(len(keep), len(flat))
        self.flat[: len(flat)] = flat
        self.place[0, : len(keep)], self.place[1, : len(keep)] = np.cumsum(lens) - lens, lens
        self.used, self.held = len(flat), held
        return keep

    def _room(self, words: int, ids: int) -> None:
        while ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while words > self.place.shape[1]:
            self.place = np.concatenate([self.place, np.zeros_like(self.place)], axis=1)
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As _ids for words without inner white space: lines of one text, which the library splits at their ends."""
        texts = ["\n".join(words[i : i + 100]) + "\n" for i in range(0, len(words), 100)]
        ids = np.concatenate([x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]).astype(np.uint32)
        ends = np.flatnonzero(ids == self.line)
        return (ids[ids != self.line], np.diff(ends, prepend=-1) - 1) if len(ends) == len(words) else None

    def _ids(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after another, and how many each has."""
        if plain and self.line is not None and (made := self._lines(words)):
            return made
        lists = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.array(x, np.uint32) for x in lists]), np.fromiter(map(len, lists), np.int64, len(lists))

    def _learn(self, words: list[str], plain: bool) -> None:
        """Put words that are not in the cache there; plain: no white space but a space before."""
        for part in (words[i : i + 20_000] for i in range(0, len(words), 20_000)):
            ids, lens = self._ids(part, plain)
            n, total = len(self.code), len(ids)
            self._room(n + len(part), self.used + total)
            self.flat[self.used : self.used + total] = ids
            self.place[0, n : n + len(part)] = self.used + np.cumsum(lens) - lens
            self.place[1, n : n + len(part)] = lens
            self.code.update(zip(part, range(n, n + len(part)), strict=True))
            self.used += total
            self.held += sum(map(len, part)) + 120 * len(part) + 4 * total

    def _whole(self, text: str) -> list[str]:
        """The parts in which an unusual text is looked up."""
        return [text]

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the cache of the pre-tokens of all texts, and how many each text has."""
        odd = {i: self._whole(x) for i, x in enumerate(texts) if x and (not self.own_rule or not STABLE.fullmatch(x) or self.special and self.special.search(x))}
        data = "\0".join(["" if x is None or i in odd else x for i, x in enumerate(texts)] + [""]).encode()
        buf = np.frombuffer(data, np.uint8)
        starts = boundaries(buf) if len(buf) else np.zeros(0, np.int64)
        offsets = np.concatenate([starts, [len(buf)]]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        ends = np.flatnonzero(buf[starts] == 0)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.asarray(words.indices)
        if self.held > self.cache_bytes:
            self._trim()
        known = np.fromiter(map(self.code.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = [w for w, n in zip(distinct, known.tolist(), strict=True) if n < 0 and w != "\0"]
        if missing or odd:
            space = [w for w in missing if w.isspace()]
            self._learn([w for w in missing if not w.isspace()] if space else missing, True)
            self._learn(space, False)
            self._learn(list({w for x in odd.values() for w in x if w not in self.code}), False)
            known = np.fromiter(map(self.code.get, distinct, repeat(-1)), np.int64, len(distinct))
        self.uses[known[known >= 0]] += 1
        codes, counts = known[number], np.diff(ends, prepend=-1) - 1
        keep = np.ones(len(codes), bool)
        keep[ends] = False
        codes = codes[keep]
        if odd:
            edges = np.cumsum(counts)
            own = [np.array([self.code[w] for w in odd[i]], np.int64) if i in odd else codes[edges[i] - counts[i] : edges[i]] for i in range(len(texts))]
            codes, counts = np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
        return codes, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = self.codes(texts)
        n = self.place[1, codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.place[0, codes] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(1)
def encoder(vocab: str, cache_bytes: int = 50_000_000) -> Encoder:
    """The worker process's encoder: its cache serves one task after another."""
    return Encoder(vocab, cache_bytes)
