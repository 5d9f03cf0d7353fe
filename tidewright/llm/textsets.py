"""Vectorised hashing of texts: words, word shingles, set digests and circulant MinHash signatures, over batches of texts in numpy."""

from __future__ import annotations

import ctypes
from contextlib import suppress
from functools import cache
from typing import NamedTuple

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)  # a random odd value for each byte
STEP = int(_rng.integers(1, 2**62)) * 4 + 3  # odd, so that it has an inverse modulo 2**64
_COEF = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
#: Bytes of text that are hashed at a time, and that the powers of a hash reach over.
CHUNK, SLICE = 1 << 20, 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, modulo 2**64, for SLICE positions and a few more: as many for texts of any length."""
    out = []
    for base in (STEP, pow(STEP, -1, 2**64)):
        p = np.ones(SLICE + 64, np.uint64)
        p[1:] = U(base)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def byte_table(lower: bool, spaces: bytes | None = None, is_word=None) -> np.ndarray:
    """The value of each byte, 0 for what separates words; lower: A-Z count as a-z and nothing else changes."""
    t = _BYTE.copy()
    if lower:
        t[65:91] = _BYTE[97:123]
    if spaces is not None:
        t[list(spaces)] = 0
    if is_word is not None:
        t[[b for b in range(256) if not is_word(b)]] = 0
    return t


#: Words are runs of what isn't ASCII white space (\x20 and \x09-\x0D); A-Z are lowered.
WHITE = byte_table(True, b" \t\n\x0b\x0c\r")


class Words(NamedTuple):
    """Words of a batch: their hashes, where they start in the joined bytes, where each text's words begin (one more at the end), and the offsets of the texts."""

    hashes: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def words(texts: list[bytes], table: np.ndarray = WHITE) -> Words:
    """The words of texts, a slice at a time; a word that reaches over slices is hashed piece by piece, so that no word or text needs longer powers."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    up, down = powers()
    begins, sums, open_at = [], [], None
    for at in range(0, len(buf), SLICE):
        v = table[buf[at : at + SLICE]]
        solid = v != 0
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        s = np.flatnonzero(begin)
        if not len(s):
            open_at = None
            continue
        part = np.add.reduceat(v * up[: len(v)], s) * down[s]
        if open_at is not None and s[0] == 0:  # the word that the last slice ended in goes on
            sums[-1][-1] = U((int(sums[-1][-1]) + int(part[0]) * pow(STEP, at - open_at, 1 << 64)) % (1 << 64))
            s, part = s[1:], part[1:]
            if not len(s):
                open_at = open_at if solid[-1] else None
                continue
        begins.append(s + at)
        sums.append(part)
        open_at = int(s[-1]) + at if solid[-1] else None
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    h = _mix(np.concatenate(sums)) if sums else np.zeros(0, np.uint64)
    return Words(h, starts, np.searchsorted(starts, offsets), offsets)


def batches(texts: list[bytes]):
    """Index ranges of at most about CHUNK bytes."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def sequence_hash(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _COEF[0]
    for j in range(1, width):
        out += h[j : n + j] * _COEF[j % 16] if j < 16 else _mix(h[j : n + j] + U(j)) * _COEF[j % 16]
    return _mix(out)


class Sets(NamedTuple):
    """Distinct items of all texts in a row, ascending within a text, where each text's begin, and how many each has."""

    items: np.ndarray
    first: np.ndarray
    sizes: np.ndarray


def _distinct(p: np.ndarray) -> np.ndarray:
    p = np.sort(p)
    if len(p) > 1:
        keep = np.empty(len(p), bool)
        keep[0] = True
        np.not_equal(p[1:], p[:-1], out=keep[1:])
        p = p[keep]
    return p


def range_sets(h: np.ndarray, low: np.ndarray, high: np.ndarray, width: int = 5) -> Sets:
    """The distinct runs of width words of each range of word hashes; of a range of fewer words, the whole run; of an empty one, nothing."""
    s = sequence_hash(h, width)
    parts, sizes = [], np.zeros(len(low), np.int64)
    for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        if b - a >= width:
            p = _distinct(s[a : b - width + 1])
        elif b > a:
            p = _mix(np.array([(h[a:b] * _COEF[: b - a]).sum(dtype=np.uint64) + U(b - a)], np.uint64))
        else:
            continue
        sizes[k] = len(p)
        parts.append(p)
    return _sets(np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes)


def _sets(items: np.ndarray, sizes: np.ndarray) -> Sets:
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return Sets(items, at, sizes)


def window_sets(h: np.ndarray, low: np.ndarray, length: int, width: int = 5) -> Sets:
    """range_sets of ranges of one length, all at once."""
    rows = np.sort(sequence_hash(h, width)[low[:, None] + np.arange(length - width + 1)], axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return _sets(rows[new], new.sum(1))


def shingle_sets(w: Words, width: int = 5) -> Sets:
    """The distinct runs of width words of each text; of a text of fewer words, the whole run; of one without, nothing."""
    return range_sets(w.hashes, w.first[:-1], w.first[1:], width)


def _reduce(ufunc, values: np.ndarray, s: Sets) -> np.ndarray:
    """ufunc over the items of each text that has any."""
    return ufunc.reduceat(values, s.first[:-1][s.sizes > 0])


def digests(s: Sets) -> list[bytes | None]:
    """16 bytes that stand for the whole set, None for an empty one."""
    out: list[bytes | None] = [None] * len(s.sizes)
    if len(s.items):
        n = s.sizes[s.sizes > 0].astype(np.uint64)
        a = _mix(_reduce(np.add, _mix(s.items ^ _COEF[3]), s) + n)
        b = _mix(_reduce(np.add, _mix(s.items * _COEF[5]), s) ^ n)
        both = np.stack([a, b], 1).tobytes()
        for i, k in enumerate(np.flatnonzero(s.sizes > 0).tolist()):
            out[k] = both[16 * i : 16 * i + 16]
    return out


class Circulant:
    """MinHash from two permutations only: the first scatters the items once, the second, shifted around by one place for each coordinate, orders them."""

    def __init__(self, coordinates: int, bands: int, bits: int = 18, seed: int = 7) -> None:
        assert coordinates % bands == 0
        rng = np.random.default_rng(seed)
        self.k, self.bands, self.size = coordinates, bands, 1 << bits
        pi = rng.permutation(self.size).astype(np.uint32)
        self.wheel = np.concatenate([pi, pi[:coordinates]])  # wheel[k:][v] is pi, shifted by k, at v
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _COEF[7])

    def signature(self, s: Sets) -> np.ndarray:
        """A row of coordinates for each text that has items. The first permutation is the bijection _mix, of which the top bits are kept."""
        at = (_mix(s.items ^ _COEF[9]) >> U(64 - int(self.size).bit_length() + 1)).astype(np.intp)
        filled = s.first[:-1][s.sizes > 0]
        out = np.empty((len(filled), self.k), np.uint32)
        for k in range(self.k):
            out[:, k] = np.minimum.reduceat(self.wheel[k : k + self.size].take(at), filled)
        return out

    def band_keys(self, s: Sets) -> list[np.ndarray | None]:
        """For each text one 64-bit key for each band, None for a text without items."""
        out: list[np.ndarray | None] = [None] * len(s.sizes)
        for k, keys in zip(np.flatnonzero(s.sizes > 0).tolist(), self.keys(s), strict=True):
            out[k] = keys
        return out

    def keys(self, s: Sets) -> np.ndarray:
        """A row of one 64-bit key for each band for each text that has items."""
        if not len(s.items):
            return np.zeros((0, self.bands), np.int64)
        rows = self.signature(s).astype(np.uint64).reshape(-1, self.bands, self.k // self.bands)
        keys = np.zeros(rows.shape[:2], np.uint64) + self.salt
        for j in range(rows.shape[2]):
            keys = _mix((keys ^ rows[:, :, j]) * _COEF[j % 16] + U(j))
        return keys.view(np.int64)


def tidy() -> None:
    """Gives freed memory of this worker back to the system; workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
