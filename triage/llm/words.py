"""Words of whole texts as 64-bit hashes, straight from Arrow's byte buffers.

A word is a longest run of characters other than space and U+0009 to U+000D.
Those are single bytes in UTF-8, so words are found and hashed on bytes, in
slices of a few megabytes; no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the bits of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of some texts: ``first[k]`` to ``first[k + 1]`` are those of text k."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    text_starts: np.ndarray


def _slice(data: np.ndarray, marks: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data[low:high]; ``marks``: where texts begin in it."""
    part = data[low:high]
    space = SPACE[part]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[marks] = ~space[marks]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    reach = np.diff(np.append(starts, len(part)))
    powers = np.cumprod(np.full(int(reach.max()), BASE, np.uint64))
    place = np.arange(starts[0], len(part)) - np.repeat(starts, reach)
    values = (part[starts[0] :].astype(np.uint64) + np.uint64(1)) * powers[place]
    values[space[starts[0] :]] = 0
    inside = np.add.reduceat((~space[starts[0] :]).astype(np.int64), starts - starts[0])
    return starts + low, starts + low + inside, mix(np.add.reduceat(values, starts - starts[0]))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """All words of a string column's texts (null: none)."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    starts, ends, hashes, low = [], [], [], 0
    while low < len(data):
        high = min(low + SLICE_BYTES, len(data))
        while high < len(data) and not SPACE[data[high]]:  # not within a word
            step = np.flatnonzero(SPACE[data[high : high + 4096]])
            high = min(high + (int(step[0]) if len(step) else 4096), len(data))
        k = np.searchsorted(offsets, [low, high])
        found = _slice(data, offsets[k[0] : k[1]] - low, low, high)
        for out, x in zip((starts, ends, hashes), found):
            out.append(x)
        low = high
    if not starts:
        empty = np.zeros(0, np.int64)
        return Words(empty.astype(np.uint64), np.zeros(len(offsets), np.int64), empty, empty, data, offsets)
    starts, ends, hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def slices(batches: Iterator[pa.RecordBatch], *texts: str, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has about ``most_bytes`` of text (one document at least)."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for text in texts or ("text",))
        group = np.cumsum(sizes) // most_bytes
        for k in np.unique(group):
            low, high = np.searchsorted(group, [k, k + 1])
            yield batch.slice(low, high - low)
