"""Byte-level text rules shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z, every other byte as it is. UTF-8 continuation and lead bytes are above 0x7F, so this is safe on UTF-8.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: ASCII letters and digits and all non-ASCII bytes are word bytes (letters lower-cased); the rest become spaces.
ALNUM = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c > 127 else 32 for c in range(256))
SPACE = b" \t\n\x0b\x0c\r"


class WordHash(dict):
    """word -> 64-bit hash, for a bounded number of words at a time."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORD_HASH = WordHash()
_CACHES: dict[str, Callable[[], None]] = {"words": WORD_HASH.clear}
_last = [""]


#: Freed blocks of so many bytes go back to the system at once.
_LARGE = 4 << 20


def claim(owner: str, cache: Callable[[], None] | None = None) -> None:
    """Called at the start of a task: the worker gives back memory that earlier tasks have freed, and what it kept for another operator."""
    if cache is not None:
        _CACHES[owner] = cache
    libc = ctypes.CDLL(None)
    if not _last[0] and hasattr(libc, "mallopt"):  # else the C library keeps ever larger blocks
        libc.mallopt(-3, _LARGE)
        libc.mallopt(-1, _LARGE)
    if _last[0] not in ("", owner):
        for clear in _CACHES.values():
            clear()
    _last[0] = owner
    pa.default_memory_pool().release_unused()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in batches of at most about so many bytes of texts (binary column, null as empty), one row at least, and the texts."""
    for b in batches:
        texts, a, size = [], 0, 0
        for i, t in enumerate(b.column(column)):
            texts.append(t.as_py() or b"")
            size += len(texts[-1]) + 64
            if size >= limit or i + 1 == b.num_rows:
                yield b.slice(a, i + 1 - a), texts
                texts, a, size = [], i + 1, 0


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one row (null as empty), and where each text starts, with the end."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    return held, at - at[0]


def parts(rows: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes, one text at least, by where texts start."""
    a = 0
    while a < len(rows) - 1:
        z = max(a + 1, int(np.searchsorted(rows, rows[a] + limit, side="right")) - 1)
        yield a, z
        a = z


def classes(data: np.ndarray, table: bytes) -> np.ndarray:
    """The class of each byte by a table of 256."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def distinct(data: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """The different pieces of bytes between neighbouring starts, and which of them stands at each place."""
    found = pa.Array.from_buffers(kind, len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (the splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of a sequence of word hashes, in order."""
    if len(words) < n:
        return words[:0]
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out + words[i : len(words) - n + 1 + i] * np.uint64(2 * i + 1) + np.uint64(0x9E3779B97F4A7C15))
    return out
