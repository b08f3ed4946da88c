"""Word shingles of many texts at once, in numpy: hashed sets, set hashes and MinHash signatures.

Words are what white space leaves once A-Z are lower-cased; a shingle is SIZE consecutive words, and a text of fewer
words is one shingle. Hashes have 64 bits; `grams` keeps 48 of each, enough to tell the shingles of two texts apart.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SIZE, COORDINATES = 5, 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_FOLD_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_SEED = np.random.Generator(np.random.PCG64(20240229))
_PLACES = _SEED.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _SEED.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _SEED.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _P and of its inverse, n of each."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_P, _INVERSE):
            x = np.full(max(2 * n, 1 << 16), base)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0][:n], _powers[1][:n]


def fold_lines(text: str | None) -> bytes:
    """fold(), but line feeds stay."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD_LINES) if text else b""


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of folded text."""
    inside = np.concatenate([[False], np.frombuffer(raw, np.uint8) != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of folded text."""
    b = np.frombuffer(raw, np.uint8)
    start, end = word_places(raw)
    power, back = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(power[:-1] * (b.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)), start, end


class Sets(NamedTuple):
    sizes: np.ndarray  # of each text's set
    keys: np.ndarray  # two 64-bit hashes of each set
    signatures: np.ndarray  # COORDINATES uint32 of each
    grams: list[bytes]  # sorted, 6 bytes each


def shingles(w: np.ndarray) -> np.ndarray:
    """The hash of each SIZE consecutive words, of SIZE word hashes or more."""
    n = len(w) - SIZE + 1
    h = w[:n] * _PLACES[0]
    for k in range(1, SIZE):
        h += w[k : n + k] * _PLACES[k]
    return mix(h)


def signatures(flat: np.ndarray, at: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
    """COORDINATES uint32 for each run of shingle hashes; runs begin at `at` and may repeat hashes.

    only: the coordinates that are asked for; the others are 0.
    """
    out = np.zeros((len(at), COORDINATES), np.uint32)
    for c in range(COORDINATES) if only is None else only.tolist():
        x = flat * _TIMES[c]
        x += _PLUS[c]
        x ^= x >> np.uint64(32)
        x *= _P
        out[:, c] = (np.minimum.reduceat(x, at) >> np.uint64(16)).astype(np.uint32)
    return out


def shingle_sets(word_lists: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct shingle hashes of each list of word hashes, sorted."""
    out = []
    for w in word_lists:
        n = len(w)
        if not n:
            out.append(np.empty(0, np.uint64))
        elif n < SIZE:
            out.append(mix(np.array([np.sum(w * _PLACES[:n]) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.unique(shingles(w)))
    return out


def pack(h: np.ndarray) -> bytes:
    small = np.sort(h & np.uint64(0xFFFFFFFFFFFF))
    return small.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def describe(sets: list[np.ndarray]) -> Sets:
    sizes = np.array([len(s) for s in sets], np.int64)
    keys = np.zeros((len(sets), 2), np.uint64)
    signed = np.zeros((len(sets), COORDINATES), np.uint32)
    full = np.flatnonzero(sizes)
    if full.size:
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        keys[full, 0] = np.add.reduceat(mix(flat + np.uint64(1)), at)
        keys[full, 1] = np.add.reduceat(mix(flat ^ _P), at)
        signed[full] = signatures(flat, at)
    return Sets(sizes, keys, signed, [pack(s) for s in sets])


def describe_texts(texts: list[str | None]) -> Sets:
    raws = [fold(t) for t in texts]
    return describe(shingle_sets([word_hashes(r)[0] if r else np.empty(0, np.uint64) for r in raws]))
