"""Distinct word shingles of texts as 64-bit hashes, in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
#: Words of more bytes are hashed one by one.
LONG_WORD = 1024
CHUNK_BYTES = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NONE = np.empty(0, np.uint64)


def spread(h: np.ndarray) -> np.ndarray:
    """Each bit of the input moves about half the bits of the output."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``buffer``, lower-cased bytes that end with 8 spaces."""
    space = _SPACE[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sizes = ends - starts
    at = np.ndarray((len(buffer) - 7,), "<u8", buffer.data, strides=(1,))
    h = sizes.astype(np.uint64) * _M1
    live = np.arange(len(starts))
    done = 0
    while len(live):
        left = sizes[live] - done
        word = at[starts[live] + done] & _KEEP[np.minimum(left, 8)]
        h[live] = spread(h[live] ^ word) + _M1
        done += 8
        live = live[left > 8]
        if done > LONG_WORD:
            for i in live:
                h[i] = np.frombuffer(hashlib.blake2b(buffer[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            break
    return starts, h


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Of each text: its sorted distinct shingles; fewer words than ``width`` make one."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        part.append(raw)
        size += len(raw)
        if size > CHUNK_BYTES:
            out += _sets(part, width)
            part, size = [], 0
    return out + _sets(part, width) if part else out


def _sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    buffer = _LOWER[np.frombuffer(b" ".join(raws) + b" " * 9, np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raws])
    starts, h = word_hashes(buffer)
    last = np.searchsorted(starts, ends)  # of each text: one past its last word
    first = np.concatenate([[0], last[:-1]])
    grams = np.empty(0, np.uint64)
    if len(h) >= width:
        grams = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            grams = spread(grams * _M1 + h[k : len(h) - width + 1 + k])
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif n:
            few = np.array([n], np.uint64) * _M2
            for k in range(a, b):
                few = spread(few * _M1 + h[k : k + 1])
            out.append(few)
        else:
            out.append(NONE)
    return out
