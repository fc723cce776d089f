"""Vectorised text primitives over Arrow string columns.

A column chunk becomes one flat array of code points plus document bounds, so
folding, word splitting and hashing run as a handful of NumPy passes instead of
a Python loop over rows. Nulls are empty documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BMP = 1 << 16
OTHER, LETTER, DIGIT, MARK, SPACE = 0, 1, 2, 3, 4


def fold_char(c: str) -> str:
    """Lower case, NFKD, combining marks dropped; of one character."""
    return "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))


def fold_text(s: str) -> str:
    """Folding of a whole string; the scalar twin of :func:`fold`."""
    return "".join(map(fold_char, s))


def char_class(c: str) -> int:
    k = unicodedata.category(c)
    if k[0] == "L":
        return LETTER
    if k == "Nd":
        return DIGIT
    if k[0] == "M":
        return MARK
    return SPACE if c.isspace() else OTHER


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, folded length and folded characters (up to the longest) of each BMP code point."""
    kind = np.zeros(BMP, np.uint8)
    folded = []
    for i in range(BMP):
        if 0xD800 <= i < 0xE000:
            folded.append(chr(0xFFFD))
            continue
        c = chr(i)
        kind[i] = char_class(c)
        folded.append(fold_char(c))
    size = np.array([len(f) for f in folded], np.uint8)
    wide = np.zeros((int(size.max()), BMP), np.uint32)
    for i, f in enumerate(folded):
        for k, x in enumerate(f):
            wide[k, i] = ord(x)
    return kind, size, wide


def pieces(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Row offset and slice, each slice holding about max_bytes of text or one longer text."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for a in chunks:
        if not pa.types.is_large_string(a.type):
            a = a.cast(pa.large_string())
        ends = _offsets(a)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + max_bytes, side="right")) - 1)
            j = min(j, len(a))
            yield base + i, a.slice(i, j - i)
            i = j
        base += len(a)


def _offsets(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]


def decode(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all texts in a row, and the bounds of each text in them."""
    if not pa.types.is_large_string(a.type):
        a = a.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    off = _offsets(a)
    if not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint32), np.zeros(len(a) + 1, np.int64)
    raw = memoryview(a.buffers()[2])[int(off[0]) : int(off[-1])]
    byte = np.frombuffer(raw, np.uint8)
    try:
        codes = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        texts = [bytes(raw[int(s - off[0]) : int(e - off[0])]).decode("utf-8", "replace") for s, e in zip(off[:-1], off[1:])]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    seen = np.concatenate([[0], np.cumsum((byte & 0xC0) != 0x80, dtype=np.int64)])
    return codes, seen[off - off[0]]


def classes(codes: np.ndarray) -> np.ndarray:
    kind = _tables()[0]
    if not len(codes) or codes.max() < BMP:
        return kind[codes]
    out = kind[np.minimum(codes, BMP - 1)]
    for c in np.unique(codes[codes >= BMP]):
        out[codes == c] = char_class(chr(c))
    return out


def fold(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and their bounds; exact for characters that vanish or expand too."""
    _, size, wide = _tables()
    if not len(codes):
        return codes, bounds
    astral: dict[int, str] = {}
    low = codes
    if codes.max() >= BMP:
        low = np.minimum(codes, BMP - 1)
        astral = {int(c): fold_char(chr(c)) for c in np.unique(codes[codes >= BMP])}
    n = size[low]
    for c, f in astral.items():
        n[codes == c] = len(f)
    odd = np.flatnonzero(n != 1)
    out = wide[0][low]
    for c, f in astral.items():
        out[codes == c] = ord(f[0]) if f else 0
    if not len(odd):
        return out, bounds
    grown = np.repeat(out, n)
    shift = np.cumsum(n[odd].astype(np.int64) - 1)
    for i in np.flatnonzero(n[odd] > 1):
        at = int(odd[i] + (shift[i - 1] if i else 0))
        c = int(codes[odd[i]])
        f = astral.get(c) or fold_char(chr(c))
        grown[at : at + len(f)] = [ord(x) for x in f]
    before = np.searchsorted(odd, bounds, side="left")
    return grown, bounds + np.concatenate([[0], shift])[before]


def words(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each longest run of letters and digits; runs end with their document."""
    k = classes(codes)
    inside = (k == LETTER) | (k == DIGIT)
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    turn = np.empty(len(inside) + 1, bool)
    turn[0], turn[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=turn[1:-1])
    cut = bounds[(bounds > 0) & (bounds < len(inside))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])
    at = np.flatnonzero(turn)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    start, end = at[0::2], at[1::2]
    filled = np.diff(np.searchsorted(start, bounds, side="left"))
    return start, end, np.repeat(np.arange(len(bounds) - 1), filled)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, _UNBASE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _scattered() -> np.ndarray:
    """A 64-bit value for each code point of Unicode."""
    with np.errstate(over="ignore"):
        return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums of the polynomial (Rabin-Karp) hash modulo 2**64 up to each position."""
    power, _ = _powers(max(1, int(len(codes)).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_scattered()[codes] * power[: len(codes)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the code points in each span, wherever it lies: equal spans, equal hashes."""
    _, unpower = _powers(max(1, int(len(sums) - 1).bit_length()))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * unpower[start] + (end - start).astype(np.uint64))
