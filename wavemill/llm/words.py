"""Hashes of the words of many texts at once.

Words are runs without ASCII white space, compared in lower case (A-Z). A word's hash is a polynomial in its bytes'
random 64-bit values, taken from one running sum over all texts of a batch, so no word is touched on its own.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes whose running sum is taken at once; longer texts are parted at white space.
PIECE = 1 << 17
_G, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = re.compile(rb"[ \t-\r]")


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    value = mix(np.arange(1, 257, dtype=np.uint64) * _G)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return value, space


_VALUE, _IS_SPACE = _byte_values()
#: An odd base, 3 modulo 8, and its inverse modulo 2^64.
_BASE = int(_A) // 8 * 8 + 3
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for n places, up to the next power of two; the last table is kept."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = _powers_of(_BASE, size), _powers_of(pow(_BASE, -1, 1 << 64), size)
    return _powers[size]


def _pieces(data: bytes) -> list[bytes]:
    if len(data) <= PIECE:
        return [data]
    out, at = [], 0
    while at < len(data):
        end = _SPACE.search(data, at + PIECE)
        out.append(data[at : end.start() if end else len(data)])
        at = end.start() if end else len(data)
    return out


def _hashed(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n" + b"\n".join(pieces) + b"\n", np.uint8)
    space = _IS_SPACE[buf]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _tables(len(buf))
    upto = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * power[: len(buf)], out=upto[1:])
    h = mix((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _G)
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    return h, np.diff(np.searchsorted(starts, np.concatenate([[1], 1 + np.cumsum(sizes)])))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, one text after the other, and the number of words of each. A null text has none."""
    hashes, counts, pieces, owner, size = [], np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        h, n = _hashed(pieces)
        hashes.append(h)
        np.add.at(counts, owner, n)

    for k, t in enumerate(texts):
        for piece in _pieces(t.encode("utf-8", "surrogatepass")) if t else ():
            if size + len(piece) > PIECE and pieces:
                flush()
                pieces, owner, size = [], [], 0
            pieces.append(piece)
            owner.append(k)
            size += len(piece)
    if pieces:
        flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts
