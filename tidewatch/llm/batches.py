"""Whole Arrow batches of texts at once: words, their dictionary and ragged arrays in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = 0x20
# Text bytes and rows handled at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 4096


def _table(is_word, lower: bool) -> np.ndarray:
    """Per byte: the byte as it counts, or a space where it separates words."""
    table = np.full(256, SPACE, np.uint8)
    for byte in range(256):
        value = byte + 0x20 if lower and 0x41 <= byte <= 0x5A else byte
        if is_word(value):
            table[byte] = value
    return table


def _not_white(byte: int) -> bool:
    return not (byte == 0x20 or 0x09 <= byte <= 0x0D)


def _letter_or_digit(byte: int) -> bool:
    return 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80


# Words between ASCII white space, as they are and with A-Z lower-cased.
WHITE = _table(_not_white, lower=False)
WHITE_LOWER = _table(_not_white, lower=True)
# Words of ASCII letters (A-Z lower-cased), digits and everything beyond ASCII.
ALNUM_LOWER = _table(_letter_or_digit, lower=True)


def slices(
    batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``SLICE_ROWS`` rows and ``limit`` text bytes, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(column)))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            end = min(end, begin + SLICE_ROWS)
            yield batch.slice(begin, end - begin)
            begin = end


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(flat(texts)[1])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (with the end); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind.itemsize)
    data = texts.buffers()[2]
    begin, end = int(offsets[0]), int(offsets[-1])
    if data is None or begin == end:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8, end - begin, begin), offsets.astype(np.int64) - begin


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Values that lie in ``data`` one after the other; ``bounds`` has one more entry than values."""
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(bounds) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def encode(values: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Number of each value in the list of distinct values, and that list."""
    coded = values.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist()


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """First word of each text (with the end), and all words as a binary array."""
    if not len(data):
        return np.zeros(len(offsets), np.int64), binary_array(data, np.zeros(1, np.int64))
    mapped = table[data]
    inside = mapped != SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    bounds = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside))
    return np.searchsorted(starts, offsets), binary_array(mapped[inside], bounds)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def owners(offsets: np.ndarray) -> np.ndarray:
    """Number of the text each entry belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def gather(
    values: np.ndarray, begins: np.ndarray, lengths: np.ndarray, codes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Values of entry ``codes[0]``, then of ``codes[1]`` and so on; and where each begins (with the end)."""
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    bounds = np.concatenate(([0], ends))
    at = np.arange(bounds[-1]) + np.repeat(begins[codes] - bounds[:-1], sizes)
    return values[at], bounds
