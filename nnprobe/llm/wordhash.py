"""64-bit hashes of the words of whole texts, in numpy, in bounded pieces."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20                       # bytes hashed at once; longer texts go piece by piece
WORD_BASE = 0x9E3779B97F4A7C55        # odd multiplier of the polynomial hash
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)   # public splitmix64 constants


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a permutation of the 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(WORD_BASE))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, PIECE + (1 << 16))
        inv = pow(WORD_BASE, -1, 1 << 64)
        for key, base in (("p", WORD_BASE), ("i", inv)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POW[key] = np.cumprod(step, dtype=np.uint64)
    return _POW["p"][:n], _POW["i"][:n]


def _pieces(data: bytes):
    """Cut at white space so that no word is split; a single word longer
    than a piece stays whole."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _hash_buffer(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    p, inv = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p, out=total[1:])
    words = mix((total[ends] - total[starts]) * inv[starts])
    bounds = np.cumsum([1] + [len(x) + 1 for x in parts])
    return words, np.diff(np.searchsorted(starts, bounds))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text).  A-Z
    are lower-cased, other letters are not; None and texts without words
    have no words."""
    counts = np.zeros(len(texts), np.int64)
    out, parts, owner, held = [], [], [], 0

    def flush():
        if parts:
            words, n = _hash_buffer(parts)
            out.append(words)
            np.add.at(counts, owner, n)
            parts.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for piece in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
            parts.append(piece)
            owner.append(i)
            held += len(piece)
            if held >= PIECE:
                flush()
                held = 0
    flush()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts
