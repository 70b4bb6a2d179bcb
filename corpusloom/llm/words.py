"""Words of a column of texts as places in a list of distinct words.

Arrow splits and numbers the words, so no Python object is made of each occurrence, and hashes are of distinct words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows whose texts have ``most`` bytes or fewer together; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + most, side="right")))
        yield at, stop
        at = stop


def numbered(column: pa.Array, lower: bool = False, ascii: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place of each word among the distinct words, the distinct words, number of words up to each text's end).

    White space between words is Unicode's, or ASCII's alone. Null: no words.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    # Arrow decodes the character behind white space at a text's end; behind the last text there must be one of ours.
    column = pa.concat_arrays([column, pa.array(["-"], pa.large_string())])
    split = (pc.ascii_split_whitespace if ascii else pc.utf8_split_whitespace)(column)[:-1]
    found = split.flatten().dictionary_encode()
    places, words = found.indices.to_numpy(), found.dictionary
    offsets = split.offsets.to_numpy().astype(np.int64)
    ends = offsets[1:] - offsets[0]
    none = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
    if len(none):  # before white space at a text's start, behind it at its end
        keep = places != none[0]
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        places = places[keep]
    return places, words, ends


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial of its bytes mod 2^64, mixed with the seed."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    with np.errstate(over="ignore"):
        powers = np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[:1], size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[at], dtype=np.uint64)])
        x = total[offsets[1:] - offsets[:1]] - total[offsets[:-1] - offsets[:1]]
        x ^= np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def batches(column: pa.Array, lower: bool = False, ascii: bool = False) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """``numbered`` of each of the column's ``slices``, in order."""
    for a, b in slices(column):
        yield numbered(column.slice(a, b - a), lower, ascii)


def rows_of(ends: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def distinct(places: np.ndarray, words: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the distinct words of each text, sorted."""
    key = np.unique(rows_of(ends) * max(1, words) + places)
    return key // max(1, words), key % max(1, words)
