"""Simple-8b: integers packed into 64-bit words, vectorised with numpy.

The upper 4 bits of a word select how many values of how many bits the lower
60 bits hold. A value too large for 60 bits is escaped: a word of the last
selector with all payload bits set, and the value in the next word. Values
are packed in blocks of a fixed number; each block starts a new word, and
its first word's index is kept, so blocks are packed and unpacked together.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
# Values in a word and bits of each, by selector.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)

_FULL = np.uint64((1 << 60) - 1)
#: Largest value of each selector; of the last one, the escape mark is no value.
_MOST = (np.uint64(1) << BITS) - np.uint64(1)
_MOST[-1] = _FULL - np.uint64(1)
_ESCAPE = np.uint64(15 << 60) | _FULL
#: The least selector for a value below 2 ** 16.
_NEED = np.searchsorted(_MOST[1:], np.arange(1 << 16, dtype=np.uint64), side="left").astype(np.uint8) + np.uint8(1)


def _need(values: np.ndarray) -> np.ndarray:
    """The least selector that holds each value; 16: escape."""
    if values.max() < len(_NEED):
        return _NEED[values.astype(np.int64)]
    return np.searchsorted(_MOST[1:], values, side="left").astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and, for each block and the end, the index of its first word."""
    values = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(values), -(-len(values) // block)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    room = int(COUNT[0])
    grid = np.zeros((blocks, block + room), np.uint64)
    flat = np.zeros(blocks * block, np.uint64)
    flat[:n] = values
    grid[:, :block] = flat.reshape(blocks, block)
    need = np.ones((blocks, block + room), np.uint8)
    need[:, :block] = _need(flat).reshape(blocks, block)
    choice = np.full((blocks, block), 15, np.uint8)
    most, width = need, 1  # the largest need of so many values from each place on
    for s in range(14, -1, -1):  # the smallest selector that fits wins, so it comes last
        c = int(COUNT[s])  # at most twice the count before
        size = block + room - c + 1
        most, width = np.maximum(most[:, :size], most[:, c - width:c - width + size]), c
        fits = most[:, :block] <= max(s, 1)
        if not fits.any():
            break  # the next selectors hold more and smaller values
        np.putmask(choice, fits, s)
    lengths = np.full(blocks, block, np.int64)
    lengths[-1] = n - (blocks - 1) * block
    pos, lane = np.zeros(blocks, np.int64), np.arange(blocks)
    found = []
    while len(lane):  # one word of every block that goes on
        p = pos[lane]
        s = choice[lane, p]
        found.append((lane, p, s))
        pos[lane] = p = p + COUNT[s]
        lane = lane[p < lengths[lane]]
    lane, p, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(lane, kind="stable")
    lane, p, s = lane[order], p[order], s[order]
    words = s.astype(np.uint64) << np.uint64(60)
    flat, at0 = grid.ravel(), lane * grid.shape[1] + p
    for k in range(2, 15):
        at = np.flatnonzero(s == k)
        for j in range(int(COUNT[k]) if len(at) else 0):
            words[at] |= flat[at0[at] + j] << (BITS[k] * np.uint64(j))
    at = np.flatnonzero(s == 15)
    one = flat[at0[at]]
    big = one > _MOST[15]
    words[at] |= np.where(big, _FULL, one)
    width = np.ones(len(words), np.int64)
    width[at[big]] = 2
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint64)
    out[place] = words
    out[place[at[big]] + 1] = one[big]
    starts = np.concatenate([[0], np.cumsum(np.bincount(lane, weights=width, minlength=blocks).astype(np.int64))])
    return out, starts


def unpack(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values that :func:`pack` packed."""
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    marks = np.flatnonzero(words == _ESCAPE)
    last = -2
    for m in marks:  # a literal may look like an escape
        if m != last + 1:
            count[m + 1] = 0
            last = m
    literal = np.zeros(len(words), bool)
    literal[1:] = (count[1:] == 0)
    block_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    before = np.cumsum(count) - count
    first = before - before[starts[:-1]][block_of]
    lengths = np.full(len(starts) - 1, block, np.int64)
    lengths[-1] = n - (len(lengths) - 1) * block
    held = np.minimum(count, lengths[block_of] - first)
    of = np.repeat(np.arange(len(words)), held)
    place = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held)
    s = selector[of]
    out = (words[of] >> (BITS[s] * place.astype(np.uint64))) & ((np.uint64(1) << BITS[s]) - np.uint64(1))
    for m in np.flatnonzero(literal):
        out[np.searchsorted(of, m - 1)] = words[m]
    return out
