"""Simple-8b: 64-bit words of a 4-bit selector and 60 bits of equally wide values.

A selector says how many values of how many bits a word holds. Values of more than 60 bits are
escapes: their word holds the place of the raw value in the block's list of exceptions. Blocks of
``BLOCK`` values start at recorded word offsets, so all blocks are packed and unpacked side by side.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the format: values a word, bits a value; selector 15 is the escape.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 15
REACH = int(COUNTS.max())


def _selectors(values: np.ndarray) -> np.ndarray:
    """The widest fitting selector at each place; ``values`` has ``REACH`` zero columns behind each block."""
    chosen = np.where(values[:, :BLOCK] >> np.uint64(60), ESCAPE, 14).astype(np.uint8)
    narrow = values.astype(np.uint32) if values.max(initial=0) < 1 << 32 else values
    for selector in range(13, -1, -1):
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        fits, length = narrow <= narrow.dtype.type((1 << bits) - 1), 1
        while 2 * length <= count:
            fits = fits[:, :-length] & fits[:, length:]
            length *= 2
        if count > length:
            fits = fits[:, : fits.shape[1] - (count - length)] & fits[:, count - length :]
        fits = fits[:, :BLOCK]
        if not fits.any():
            break  # what needs fewer bits for more values fits nowhere either
        np.copyto(chosen, np.uint8(selector), where=fits)  # selectors fall, and a smaller one is right where it fits
    return chosen


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, exceptions, and for both the offset of each block with the total behind."""
    values = np.asarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        none, zero = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        return none, none, zero, zero
    held = np.zeros((blocks, BLOCK + REACH), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    held[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    ends = np.full(blocks, BLOCK)
    ends[-1] = len(values) - (blocks - 1) * BLOCK
    selectors = _selectors(held)
    at, rows, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(rows):
        chosen = selectors[rows, at]
        steps.append((rows, at, chosen))
        at = at + COUNTS[chosen]
        on = at < ends[rows]
        rows, at = rows[on], at[on]
    row, start, chosen = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(row, kind="stable")  # steps of a block are already in order
    row, start, chosen = row[order], start[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat, place = held.ravel(), row * (BLOCK + REACH) + start
    for selector in range(1, ESCAPE):
        which = np.flatnonzero(chosen == selector)
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        base, packed = place[which], words[which]
        for i in range(count):
            packed |= flat[base + i] << np.uint64(i * bits)
        words[which] = packed
    escaped = np.flatnonzero(chosen == ESCAPE)
    exceptions = held[row[escaped], start[escaped]]
    exception_offsets = np.searchsorted(row[escaped], np.arange(blocks + 1))
    words[escaped] |= (np.arange(len(escaped)) - exception_offsets[row[escaped]]).astype(np.uint64)
    return words, exceptions, np.searchsorted(row, np.arange(blocks + 1)), exception_offsets


def unpack(words: np.ndarray, exceptions: np.ndarray, offsets: np.ndarray, exception_offsets: np.ndarray, total: int) -> np.ndarray:
    """The values of all given blocks; ``total`` cuts what fills up the last word of the last block."""
    blocks = len(offsets) - 1
    out = np.zeros(blocks * BLOCK + REACH, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    row = np.repeat(np.arange(blocks), np.diff(offsets))
    before = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    start = before - before[offsets[:-1]][row] if len(words) else before
    for selector in range(1, ESCAPE):
        which = np.flatnonzero(chosen == selector)
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        mask = np.uint64((1 << bits) - 1)
        base, packed = row[which] * BLOCK + start[which], words[which]
        for i in range(count):
            # the last word of a block may hang over its end
            inside = start[which] + i < BLOCK
            out[base[inside] + i] = (packed[inside] >> np.uint64(i * bits)) & mask
    escaped = np.flatnonzero(chosen == ESCAPE)
    payload = (words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)
    out[row[escaped] * BLOCK + start[escaped]] = exceptions[exception_offsets[row[escaped]] + payload]
    return out[:total]
