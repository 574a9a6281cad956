"""Sets of word shingles as 64-bit hashes, computed for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

#: Words per shingle.
WIDTH = 5
#: Fixed odd multiplier of the byte hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A hash of each byte.
BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (1 << 64) - 1))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 text, A-Z lower-cased, and where each begins; about `chunk` bytes at once."""
    b = LOWER[np.frombuffer(data, np.uint8)]
    blank = BLANK[b]
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + chunk, "right")))
        at = start[i]
        some = b[at : end[j - 1]]
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(BYTES[some] * powers(BASE, len(some)), out=sums[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * powers(INVERSE, len(some) + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out, start


def shingle_sets(texts: list[str | None], block: int = 1_000_000) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes: none without words, the whole sequence if shorter than a shingle."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > block:
            out += sets_of(held)
            held, size = [], 0
    return out + sets_of(held)


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    if not texts:
        return []
    words, start = word_hashes(b"\n".join(texts))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    cut = np.searchsorted(start, begin)
    if len(words) >= WIDTH:
        wide = len(words) - WIDTH + 1
        grams = np.zeros(wide, np.uint64)
        for k in range(WIDTH):
            grams = mix(grams * np.uint64(3) + words[k : k + wide] + np.uint64(k))
    else:
        grams = np.zeros(0, np.uint64)
    out = []
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if j - i >= WIDTH:
            out.append(np.unique(grams[i : j - WIDTH + 1]))
        elif j > i:
            h = np.full(1, np.uint64(j - i))
            for k in range(i, j):
                h = mix(h * np.uint64(5) + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
