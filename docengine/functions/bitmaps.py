"""Compressed bitmaps.

A container holds positions in [0, SPAN) as a byte string: one tag byte, then the
little-endian payload in whichever of three layouts is smallest: sorted positions (tag 0),
runs as (start, length - 1) pairs (tag 1) or 8,192 bytes of plain bits (tag 2). A bitmap
holds any positions as a map from their upper bits to a container.
"""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16
EMPTY = b"\x00"


def encode(positions: np.ndarray) -> bytes:
    """Compress a sorted array of distinct positions in [0, SPAN)."""
    p = np.asarray(positions, dtype=np.int64)
    if not len(p):
        return EMPTY
    if p[0] < 0 or p[-1] >= SPAN:
        raise ValueError("position outside the range of one bitmap")
    starts = np.flatnonzero(np.diff(p, prepend=-2) != 1)
    lengths = np.diff(np.append(starts, len(p)))
    sizes = (2 * len(p), 4 * len(starts), SPAN // 8)
    kind = int(np.argmin(sizes))
    if kind == 0:
        body = p.astype("<u2").tobytes()
    elif kind == 1:
        body = np.stack([p[starts], lengths - 1], axis=1).astype("<u2").tobytes()
    else:
        body = _bits_of(p).tobytes()
    return bytes([kind]) + body


def _bits_of(positions: np.ndarray) -> np.ndarray:
    bits = np.zeros(SPAN, dtype=bool)
    bits[positions] = True
    return np.packbits(bits)


def decode(bitmap: bytes) -> np.ndarray:
    """Sorted positions of a container."""
    kind, body = bitmap[0], bitmap[1:]
    if kind == 0:
        return np.frombuffer(body, "<u2").astype(np.int64)
    if kind == 1:
        runs = np.frombuffer(body, "<u2").astype(np.int64).reshape(-1, 2)
        total = runs[:, 1] + 1
        base = np.repeat(runs[:, 0] - np.append(0, np.cumsum(total)[:-1]), total)
        return base + np.arange(total.sum())
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8)))


def _bits(bitmap: bytes) -> np.ndarray:
    return np.frombuffer(bitmap[1:], np.uint8) if bitmap[0] == 2 else _bits_of(decode(bitmap))


def and_not(a: bytes, b: bytes) -> bytes:
    """Positions of container ``a`` that are not in ``b``. Positions are looked up in the
    bits or runs of b; everything else is an AND-NOT of bits."""
    if len(a) == 1 or len(b) == 1:
        return a
    if a[0] == 0:
        p = np.frombuffer(a[1:], "<u2")
        if b[0] == 2:
            held = np.frombuffer(b[1:], np.uint8)[p >> 3] >> (7 - (p & 7)) & 1 > 0
        elif b[0] == 1:
            runs = np.frombuffer(b[1:], "<u2").astype(np.int64).reshape(-1, 2)
            at = np.searchsorted(runs[:, 0], p, side="right") - 1
            held = (at >= 0) & (p <= runs[at].sum(axis=1))
        else:
            held = np.isin(p, np.frombuffer(b[1:], "<u2"), assume_unique=True)
        return EMPTY + p[~held].tobytes()
    bits = _bits(a) & ~_bits(b)
    if np.bitwise_count(bits).sum() * 2 >= SPAN // 8:
        return b"\x02" + bits.tobytes()
    return encode(np.flatnonzero(np.unpackbits(bits)))


def encode_any(positions: np.ndarray) -> dict[int, bytes]:
    """Bitmap of sorted distinct positions from 0 on."""
    high = positions // SPAN
    cuts = np.flatnonzero(np.diff(high)) + 1
    return {int(p[0] // SPAN): encode(p % SPAN) for p in np.split(positions, cuts) if len(p)}


def decode_any(bitmap: dict[int, bytes]) -> np.ndarray:
    parts = [decode(c) + h * SPAN for h, c in sorted(bitmap.items())]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def and_not_any(a: dict[int, bytes], b: dict[int, bytes]) -> dict[int, bytes]:
    return {h: and_not(c, b.get(h, EMPTY)) for h, c in a.items()}
