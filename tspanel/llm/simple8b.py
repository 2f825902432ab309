"""Word-aligned packing of ids: a 4-bit selector and up to 60 data bits in each 64-bit word.

Blocks of ``BLOCK`` ids are packed independently, so that all blocks of an array advance
together, one word each per step, and so that a reader can start at any block. The selector
names how many values of which width follow. ``ESCAPE`` says that the next word is one raw
64-bit value, for values that need over 60 bits. The last word of a block may hold fewer
values than its selector says; the block's length tells.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
ESCAPE = 0
# fixed values: number and width of the values under selectors 1 to 15
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < 1 << 52:
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), values, "right").astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words of each block)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.zeros(blocks * BLOCK + COUNTS.max(), np.uint64)
    padded[:n] = values
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - BLOCK * (blocks - 1)
    bits = np.zeros((blocks, BLOCK + COUNTS.max()), np.uint8)  # beyond a block's end nothing needs a bit
    bits[:, :BLOCK].reshape(-1)[:n] = 0
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = bit_lengths(values)
    bits[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    widest = {1: bits}  # largest width among the next 2^k values
    for k in (2, 4, 8, 16, 32, 64):
        half, out = widest[k // 2], widest[k // 2].copy()
        np.maximum(half[:, : -(k // 2)], half[:, k // 2 :], out=out[:, : -(k // 2)])
        widest[k] = out
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(15, 0, -1):  # the selector with the most values comes last and wins
        c = int(COUNTS[s])
        k = 1 << (c.bit_length() - 1)
        both = np.maximum(widest[k][:, :BLOCK], widest[k][:, c - k : c - k + BLOCK])
        choice[both <= WIDTHS[s]] = s
    rows, at, selectors, places = np.arange(blocks), np.zeros(blocks, np.int64), [], []
    while len(rows):
        s = choice[rows, at]
        selectors.append((rows, s))
        places.append(rows * BLOCK + at)
        at = at + COUNTS[s]
        go = at < lengths[rows]
        rows, at = rows[go], at[go]
    block = np.concatenate([r for r, _ in selectors])
    order = np.argsort(block, kind="stable")
    block, s, place = block[order], np.concatenate([x for _, x in selectors])[order], np.concatenate(places)[order]
    size = np.where(s == ESCAPE, 2, 1)
    end = np.cumsum(size)
    words = np.zeros(end[-1], np.uint64)
    words[end - size] = s.astype(np.uint64) << np.uint64(60)
    limit = np.minimum((block + 1) * BLOCK, n)
    for k in np.unique(s):
        pick = np.flatnonzero(s == k)
        if k == ESCAPE:
            words[end[pick] - 1] = padded[place[pick]]
        elif WIDTHS[k]:
            word = words[end[pick] - 1]
            for j in range(COUNTS[k]):
                p = place[pick] + j
                word |= np.where(p < limit[pick], padded[p], np.uint64(0)) << np.uint64(j * WIDTHS[k])
            words[end[pick] - 1] = word
    return words, np.bincount(block, size, minlength=blocks).astype(np.int64)


def unpack(words: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """n values from the words of whole blocks; sizes: number of words of each block."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    first = np.cumsum(sizes) - sizes
    s = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    looks = s == ESCAPE
    if looks.any():  # in a run of words that look like escapes every second one is a raw value
        begins = looks.copy()
        begins[1:] &= ~looks[:-1]
        begins[first] |= looks[first]
        start = np.maximum.accumulate(np.where(begins, np.arange(len(words)), 0))
        raw[1:] = (looks & ((np.arange(len(words)) - start) % 2 == 0))[:-1]
        raw[first] = False
    real = np.flatnonzero(~raw)
    s, block = s[real], np.repeat(np.arange(len(sizes)), sizes)[real]
    counts = COUNTS[s]
    before = np.cumsum(counts) - counts
    lead = np.searchsorted(real, first)
    place = block * BLOCK + before - before[lead][block]
    limit = np.minimum((block + 1) * BLOCK, n)
    for k in np.unique(s):
        pick = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[place[pick]] = words[real[pick] + 1]
        elif WIDTHS[k]:
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            for j in range(COUNTS[k]):
                p = place[pick] + j
                fits = p < limit[pick]
                out[p[fits]] = (words[real[pick[fits]]] >> np.uint64(j * WIDTHS[k])) & mask
    return out
