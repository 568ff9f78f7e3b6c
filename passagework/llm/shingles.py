"""Word shingles of texts as 64-bit hashes, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_draw = np.random.default_rng(20240229)


def _odd(n: int) -> np.ndarray:
    return _draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


LETTER = _odd(256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LETTER = LETTER[_LOWER]
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True
BASE = _odd(1)[0]
PLACE = _odd(64)
SHORT = _odd(1)[0]
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
BYTES_AT_ONCE = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def _inverse(p: int) -> int:
    return pow(p, -1, 2**64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word of UTF-8 ``data`` (words end at blanks and control white space, A-Z are
    lower-cased) and its hash, a polynomial over random letters."""
    gap = GAP[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    n = len(data)
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[data] * power, out=total[1:])
    back = np.full(n, np.uint64(_inverse(int(BASE))), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return starts, mix((total[ends] - total[starts]) * back[starts])


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in texts:
        if held and size + len(x) > BYTES_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x) + 1
    if held:
        yield held


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of ``words`` words; a text with fewer
    words has one shingle of all of them, one without words has none."""
    for group in _groups([(x or "").encode("utf-8", "surrogatepass") for x in texts]):
        data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
        starts, hashes = word_hashes(data)
        edges = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in group)]))
        run = np.zeros(0, np.uint64)
        if len(hashes) >= words:
            run = hashes[: len(hashes) - words + 1] * PLACE[0]
            for i in range(1, words):
                run += hashes[i : len(hashes) - words + 1 + i] * PLACE[i]
            run = mix(run)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(run[a : b - words + 1])
            elif b > a:
                yield mix((hashes[a:b] * PLACE[: b - a]).sum(keepdims=True) + SHORT * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    if not len(hashes):
        return 0
    both = np.array([mix(hashes).sum(), np.bitwise_xor.reduce(mix(hashes ^ _M2)), len(hashes)], np.uint64)
    return int(mix((both * PLACE[:3]).sum(keepdims=True)).view(np.int64)[0])
