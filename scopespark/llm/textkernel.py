"""Vectorised word kernel: whole columns of texts as one byte buffer.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z, so that work on UTF-8
bytes equals work on code points.  A word's identity is a 64-bit hash from one prefix sum over the
buffer; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes handled at once; bounds the memory of the uint64 arrays below.
BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The other choice of separators: every ASCII byte that is no letter or digit.
PUNCTUATION = np.arange(256) < 128
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """base**i (or its inverse) for i below n, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), _BASE if kind == "up" else _INV, dtype=np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def to_bytes(texts: Sequence) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in texts]


def blocks(rows: Sequence[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes add up to about ``size``; a longer row stands alone."""
    first = total = 0
    for i, x in enumerate(rows):
        if i > first and total + len(x) > size:
            yield first, i
            first, total = i, 0
        total += len(x) + 1
    if first < len(rows):
        yield first, len(rows)


def _words(buf: np.ndarray, gaps: np.ndarray = _SPACE, prefixes: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of one lower-cased buffer, and hashes[k] of whole words and of their prefixes."""
    gap = gaps[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("up", len(buf)), out=total[1:])
    shift, first = _power("down", len(buf) + 1)[start], total[start]
    hashes = []
    for stop in (end, *(np.minimum(end, start + k) for k in prefixes)):
        h = (total[stop] - first) * shift
        hashes.append(mix64(h ^ ((stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
    return start, np.stack(hashes)


def _split_long(row: bytes) -> Iterator[bytes]:
    """Pieces of a long row, cut at white space where there is any."""
    at = 0
    while len(row) - at > BLOCK:
        piece = row[at : at + BLOCK]
        cut = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= 0:  # one word longer than a block: take it whole
            nxt = [p for p in (row.find(c, at + BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
            cut = (min(nxt) if nxt else len(row)) - at
        yield row[at : at + cut + 1]
        at += cut + 1
    yield row[at:]


def word_hashes(rows: Sequence[bytes], gaps: np.ndarray = _SPACE, prefixes: Sequence[int] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of rows: first row, end row, word hashes, and word offsets of each row.

    Row ``first + k`` owns ``hashes[offsets[k]:offsets[k + 1]]``.  With ``prefixes`` (numbers of bytes)
    hashes[0] holds the whole words and hashes[1:] those prefixes of them.
    """
    for lo, hi in blocks(rows):
        if hi - lo == 1 and len(rows[lo]) > BLOCK:
            parts = [_words(_LOWER[np.frombuffer(p, dtype=np.uint8)], gaps, prefixes)[1] for p in _split_long(rows[lo]) if p]
            hashes = np.concatenate(parts, axis=1)
            offsets = np.array([0, hashes.shape[1]])
        else:
            buf = _LOWER[np.frombuffer(b"\n".join(rows[lo:hi]) + b"\n", dtype=np.uint8)]
            start, hashes = _words(buf, gaps, prefixes)
            ends = np.cumsum([len(x) + 1 for x in rows[lo:hi]])
            offsets = np.concatenate(([0], np.searchsorted(start, ends)))
        yield lo, hi, hashes if prefixes else hashes[0], offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each row, and their offsets.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    n = np.diff(offsets)
    acc = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(width):
        shifted = hashes[k:] * np.uint64(2 * k + 1) ^ np.uint64(0xA0761D6478BD642F * (k + 1) % (1 << 64))
        acc[: len(shifted)] = mix64(acc[: len(shifted)] + shifted)
    have = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_offsets = np.concatenate(([0], np.cumsum(have)))
    row = np.repeat(np.arange(len(n)), have)
    out = acc[offsets[row] + (np.arange(out_offsets[-1]) - out_offsets[row])] if len(row) else acc[:0]
    for r in np.flatnonzero((n > 0) & (n < width)):
        h = np.array([n[r]], dtype=np.uint64)
        for k in range(offsets[r], offsets[r + 1]):
            h = mix64((h + hashes[k : k + 1]) * np.uint64(0xE7037ED1A0B428DB))
        out[out_offsets[r]] = h[0]
    return out, out_offsets
