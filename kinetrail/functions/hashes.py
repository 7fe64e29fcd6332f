"""MD5 of many short messages at a time, for draws that a query fixes by hash."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_STEP, _FIRST = (1, 5, 3, 7), (0, 1, 5, 0)
#: Messages that are hashed together: what they need stays in a core's cache.
TOGETHER = 1 << 15


def _words(texts: Sequence[bytes], at: int, size: int) -> np.ndarray:
    """(texts, size / 4): texts of one length as little-endian words, at bytes in."""
    cells = np.zeros((len(texts), size), "u1")
    cells[:, at : at + len(texts[0])] = np.frombuffer(b"".join(texts), "u1").reshape(len(texts), -1)
    return cells.view("<u4")


def _mix(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if i < 16:
        np.bitwise_xor(c, d, out=out)
        out &= b
        out ^= d
    elif i < 32:
        np.bitwise_xor(b, c, out=out)
        out &= d
        out ^= c
    elif i < 48:
        np.bitwise_xor(b, c, out=out)
        out ^= d
    else:
        np.invert(d, out=out)
        out |= b
        out ^= c


def _added(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The word of each pair, of one side alone where the other has none."""
    if not tail.any():
        return head[:, None]
    return head[:, None] + tail[None, :] if head.any() else tail[None, :]


def _digest(heads: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
    """The four words of each head's digest with each tail; their words add up to
    those of the padded messages."""
    state = [np.full((len(heads), len(tails)), x) for x in _START]
    for block in range(0, heads.shape[1], 16):
        words = [_added(heads[:, k], tails[:, k]) for k in range(block, block + 16)]
        a, b, c, d = (x.copy() for x in state)
        f = np.empty_like(a)
        for i in range(64):
            kind = i // 16
            _mix(i, b, c, d, f)
            f += a
            f += words[(_STEP[kind] * i + _FIRST[kind]) % 16] + _ADDED[i]
            shift = _SHIFTS[kind][i % 4]
            np.right_shift(f, np.uint32(32 - shift), out=a)
            f <<= np.uint32(shift)
            f |= a
            f += b
            a, b, c, d, f = d, f, b, c, a
        state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    return state


def md5_numbers(heads: Sequence[bytes], tails: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of heads, places of tails, numbers): the first 12 hex digits of
    md5(head + tail) as a whole number, for each pair once, in blocks."""
    of_length = lambda texts: ((n, np.flatnonzero(lengths == n)) for lengths in [np.array([len(x) for x in texts])] for n in np.unique(lengths))
    for n, rows in of_length(heads):
        for m, columns in of_length(tails):
            size = (n + m + 8) // 64 * 64 + 64
            padded = [tails[k] + b"\x80" for k in columns]
            last = _words(padded, n, size)
            last[:, -2:] |= np.array([(8 * (n + m)) & 0xFFFFFFFF, (8 * (n + m)) >> 32], "<u4")
            step = max(1, TOGETHER // len(columns))
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                first = _words([heads[j] for j in own], 0, size) if n else np.zeros((len(own), size // 4), "<u4")
                a, b, *_ = _digest(first, last)
                yield own, columns, (a.byteswap().astype("u8") << np.uint64(16)) | b.astype("u2").byteswap()
