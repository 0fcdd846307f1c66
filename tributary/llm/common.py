"""What the operators of this subpackage share: written tables, slices of Arrow columns, vectorised word hashing.

Nothing here collects rows to the driver.  Texts are handled in slices of about ``SLICE_BYTES`` so that a Python worker holds
a small multiple of that (or of the single longest text) whatever the size of an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship, written

__all__ = ["Words", "id_and_text", "mix", "release", "shared_dir", "slices", "spans_hash", "table", "utf8", "written"]

SLICE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, under names of its own, so that further columns can't clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def release() -> None:
    """Give back what this Python worker holds but doesn't use, before and after an operator's task: workers serve one stage after
    another, and the token operators keep a cache for their own later tasks."""
    for module, name in (("tokens", "encoder"), ("bpe_trie", "_encoder")):
        f = getattr(sys.modules.get(f"{__package__}.{module}"), name, None)
        if f and f.cache_info().currsize:
            f.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each (one row at least)."""
    if not len(texts):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64) + 64)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to


def utf8(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


# --- 64-bit hashing, vectorised -------------------------------------------------------------------------------------------

U = np.uint64
_R = U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


BYTE_KEYS = mix(np.arange(1, 257, dtype=U) * _R)
#: White space of the word definition: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n; kept for common slice sizes only."""
    if n > len(_powers.get("up", ())):
        m = max(n, 1 << 19)
        inverse = U(pow(int(_R), -1, 1 << 64))
        up, down = np.full(m, _R), np.full(m, inverse)
        up[0] = down[0] = 1
        np.cumprod(up, dtype=U, out=up)
        np.cumprod(down, dtype=U, out=down)
        if m > 1 << 20:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span buf[start:end] that depends on its bytes and length only."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    keyed = BYTE_KEYS[buf]
    keyed *= up[: len(buf)]
    np.cumsum(keyed, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """The white-space separated words of some texts: byte spans in one buffer, their texts and their hashes.

    ``count[i]`` is the number of words of text i and ``first[i]`` the place of its first word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, gap: int = 1):
        """gap: spaces before, between and after the texts."""
        space = b" " * gap
        self.buf = np.frombuffer(space + space.join(texts) + space, np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = gap + np.concatenate([[0], np.cumsum(lens + gap)])
        space = SPACE[self.buf]
        before = np.concatenate([[True], space[:-1]])
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(space & ~before)
        edges = np.searchsorted(self.starts, self.base)
        self.first, self.count = edges[:-1], np.diff(edges)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.buf, self.starts, self.ends)
