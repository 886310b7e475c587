"""Word hashing straight on Arrow's string buffers, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_U64 = np.uint64
_tables: dict[str, np.ndarray] = {}

#: Bytes that end a word: ASCII white space; or all of ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = [not chr(b).isalnum() for b in range(128)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = 1 << max(21, int(n).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", _MULT), ("down", _INV)):
                steps = np.full(size, base, _U64)
                steps[0] = 1
                _tables[key] = np.cumprod(steps, dtype=_U64)
    return _tables["up"], _tables["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U64(33))
        h = h * _U64(0xFF51AFD7ED558CCD)
        h ^= h >> _U64(33)
        h *= _U64(0xC4CEB9FE1A85EC53)
        h ^= h >> _U64(33)
    return h


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def doc_slices(offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about target bytes each; a longer text is alone in its range."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def _hash_piece(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    word = ~sep[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U64)
        np.cumsum((data.astype(_U64) + _U64(1)) * up[:n], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h ^= (e - s).astype(_U64) * _U64(0xD6E8FEB86659FD93)
    return mix64(h), s, e


def hash_words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts in order: their 64-bit hashes, texts' numbers, first bytes and ends.

    The bytes are taken in pieces that end between words, so that a very long
    text needs no more memory than its words.
    """
    hs, ss, es = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + piece)
        if to < n:
            gap = np.flatnonzero(sep[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                rest = np.flatnonzero(sep[data[to:]])
                to = to + int(rest[0]) + 1 if len(rest) else n
        h, s, e = _hash_piece(data[at:to], offsets - at, sep)
        hs.append(h)
        ss.append(s + at)
        es.append(e + at)
        at = to
    if not hs:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U64), none, none, none
    s = np.concatenate(ss)
    return np.concatenate(hs), np.searchsorted(offsets, s, "right") - 1, s, np.concatenate(es)
