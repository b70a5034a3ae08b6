"""Vectorised word shingles: 64-bit hashes of runs of words, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
LOT_BYTES = 1 << 20
_P = 0x5851F42D4C957F2D
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n + 1:
        size = max(n + 1, LOT_BYTES + (1 << 17))
        up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are not ASCII white space, A-Z lower-cased), and where each text's begin."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[end] - sums[start]) * down[start])
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return words, np.searchsorted(start, bounds)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, the whole sequence as one; without words, none."""
    words, at = word_hashes(texts)
    whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += words[k : k + len(whole)] * _PLACE[k]
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif n:
            short = (words[a:b] * _PLACE[:n]).sum(dtype=np.uint64) + _PLACE[WORDS] * np.uint64(n)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lots(texts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (text bytes, ...) in lots of about LOT_BYTES."""
    lot, held = [], 0
    for row in texts:
        lot.append(row)
        held += len(row[0])
        if held >= LOT_BYTES:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot
