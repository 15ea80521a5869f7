"""Words of Arrow batches as numpy arrays.

A batch of texts is one buffer of bytes.  Word borders come from a table of
256 byte classes and word numbers from a polynomial hash over each word's
bytes, both for a whole slice of the buffer at once, so no Python object is
made per word.  All breaking characters are ASCII, hence UTF-8 needs no
decoding.

A slice holds whole texts of about ``SLICE`` bytes together; a longer text is
cut behind a byte at which the caller allows it, so memory is bounded by the
slice (or by a longer stretch without such a byte) and never by a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# fixed values: the breaking characters \x20 and \x09-\x0D
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEAR = 1 << 16


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(_BASE, SLICE)
_INVERSE = powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), SLICE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of one slice: where they stand in ``data`` and in which text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray

    def numbers(self) -> np.ndarray:
        """A 64-bit number per word; equal words have equal numbers."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        sizes = self.ends - self.starts
        if len(self.data) <= SLICE:
            # differences of running sums, moved to the start of the word
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data + np.uint64(1)) * _POWERS[:len(self.data)], out=sums[1:])
            value = (sums[self.ends] - sums[self.starts]) * _INVERSE[self.starts]
            return mixed(value + sizes.astype(np.uint64))
        first = np.cumsum(sizes) - sizes
        # byte positions of all words, and each byte's place in its word
        place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
        at = place + np.repeat(self.starts, sizes)
        weight = _POWERS[place & (_NEAR - 1)]
        if sizes.max() > _NEAR:
            far = powers(_POWERS[_NEAR], int(sizes.max()) // _NEAR + 1)
            weight = weight * far[place >> 16]
        value = (self.data[at].astype(np.uint64) + np.uint64(1)) * weight
        return mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(column: pa.Array, cut: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last text, bytes, offsets within the bytes).

    A text above ``size`` comes alone, in parts that end behind a byte of the
    class ``cut``."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        if j > i:
            j = min(j, n)
            yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            stop = end
            if end - at > size:
                found = np.flatnonzero(cut[data[at:at + size]])
                if len(found):
                    stop = at + int(found[-1]) + 1
                else:
                    step = at + size
                    while step < end:
                        found = np.flatnonzero(cut[data[step:step + size]])
                        if len(found):
                            stop = step + int(found[0]) + 1
                            break
                        step += size
            yield i, i + 1, data[at:stop], np.array([0, stop - at], dtype=np.int64)
            at = stop
        i += 1


def words_in(data: np.ndarray, offsets: np.ndarray, first: int, breaks: np.ndarray) -> Words:
    """Words of a slice that begins with text ``first``."""
    inside = ~breaks[data]
    edge = offsets[:-1]
    edge = edge[edge < len(data)]
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    text = first + np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, starts, ends, text)


def numbered_words(column: pa.Array, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of every word of a column of texts, in order."""
    numbers, texts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for first, _, data, offsets in slices(column, breaks):
        found = words_in(data, offsets, first, breaks)
        numbers.append(found.numbers())
        texts.append(found.text)
    return np.concatenate(numbers), np.concatenate(texts)
