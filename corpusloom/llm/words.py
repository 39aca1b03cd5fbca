"""Words, shingles and windows of texts as 64-bit hashes, vectorised over many texts.

A word is a run of bytes other than the six ASCII white-space bytes, so words are
found in the UTF-8 bytes without decoding. A word's hash is a polynomial over a
random 64-bit number per byte value, taken from running sums and then mixed;
it depends on the word alone, never on its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text that are hashed at once; a longer text is hashed on its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(CHUNK + 1, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column: the first row's index, the bytes, the bounds of each text in them.

    A null text counts as empty.
    """
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        yield at, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def hash_words(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and for each text the bounds of its words."""
    n = len(data)
    space = np.ones(n + 1, bool)
    np.take(_SPACE, data, out=space[:n])
    first = ~space[:n]
    last = first.copy()
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    if n:
        opens = space[: n - 1].copy()
        opens[inner - 1] = True
        first[1:] &= opens
        closes = space[1:n].copy()
        closes[inner - 1] = True
        last[: n - 1] &= closes
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    values = _BYTES[_LOWER[data] if lower else data] * _power("up", int(_BASE), n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    inverse = pow(int(_BASE), -1, 1 << 64)
    hashes = mix((sums[ends] - sums[starts]) * _power("down", inverse, n + 1)[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` hashes; empty when there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 16:
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * np.uint64(_STEP) + hashes[k : k + n]
        return mix(out)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power("step", _STEP, len(hashes)), out=sums[1:])
    down = _power("unstep", pow(_STEP, -1, 1 << 64), n)
    return mix((sums[size:] - sums[:n]) * down)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct shingles of one text, sorted; a text with fewer words is one shingle; no word, none."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return grams(hashes, n) + np.uint64(n)
    return np.unique(grams(hashes, size))
