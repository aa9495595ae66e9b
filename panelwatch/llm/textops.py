"""Array helpers that run inside tasks: whole texts to word hashes, n-gram hashes and letter codes.

All of them work on one Arrow slice at a time (:func:`slices`), so a task holds a few megabytes of text, or one
text if that text is longer. Texts are never cut.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)


def worker_store() -> dict:
    """A dict that lives as long as the Python worker process, for tables built once per process."""
    module = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store"))
    return module.__dict__.setdefault("items", {})


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of at most ``limit`` text bytes (one row if a text is longer)."""
    for batch in batches:
        size = np.cumsum(text_bytes(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text begins (with the end as last entry)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_table(spaces_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: is it part of a word, and the byte after A-Z became a-z.

    Words are runs of 0-9, a-z and non-ASCII characters; with ``spaces_only`` runs of anything but the space and
    the characters 9 to 13.
    """
    byte = np.arange(256)
    if spaces_only:
        member = ~((byte == 32) | ((byte >= 9) & (byte <= 13)))
    else:
        member = ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    return member, np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)


def word_hashes(column: pa.Array, spaces_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text."""
    return word_places(*raw(column), spaces_only)[:2]


def word_places(data: np.ndarray, offsets: np.ndarray, spaces_only: bool = False):
    """Hashes and counts as in :func:`word_hashes`, and first byte and length in bytes of each word."""
    texts = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64), none, none
    member, lower = word_table(spaces_only)
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[1:-1]
    begins = begins[(begins > 0) & (begins < len(data))]
    first[begins] = inside[begins]
    last[begins - 1] = inside[begins - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    # eight bytes at a time, from any place
    padded = np.concatenate([lower[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    hashes, mask = lengths.astype(np.uint64), np.append(np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8)), np.uint64(0)) - np.uint64(1)
    rest, done = np.arange(len(starts)), 0
    while len(rest):
        part = eight[starts[rest] + done] & mask[np.minimum(lengths[rest] - done, 8)]
        h = (hashes[rest] ^ part) * GOLD
        hashes[rest] = h ^ (h >> np.uint64(29))
        done += 8
        rest = rest[lengths[rest] > done]
    return mix(hashes), np.diff(np.searchsorted(starts, offsets)), starts, lengths


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all runs ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)


def grams(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words with the text's row number.

    A text with fewer words has one gram of all its words, a text without words none.
    """
    rows = row_of(counts)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    odd = np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum(counts)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        shifted = np.zeros(n, np.uint64)
        shifted[:n - k] = hashes[k:]
        short = np.arange(n) + k >= ends[rows]
        shifted[short] = 0
        out = out * odd + shifted
    place = np.arange(n) - (ends - counts)[rows]
    keep = (place + width <= counts[rows]) | ((place == 0) & (counts[rows] < width))
    return mix(out[keep]), rows[keep]


def weighted_grams(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of each text as (row, 44-bit gram, count), sorted by row and gram."""
    gram, rows = grams(hashes, counts, width)
    if len(counts) >= 1 << 20:
        raise ValueError("too many texts in one slice")
    key = (rows.astype(np.uint64) << np.uint64(44)) | (gram >> np.uint64(20))
    key, times = np.unique(key, return_counts=True)
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), times


def letter_classes() -> np.ndarray:
    """Class of each code point below 0x40000: 0 no letter, 1-26 a-z, 27-63 other letters (spread by code)."""
    store = worker_store()
    if "letters" not in store:
        table = np.zeros(0x40000, np.uint8)
        for code in range(0x40000):
            c = chr(code)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[code] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 37
        store["letters"] = table
    return store["letters"]


def letter_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts, each followed by one 0, and where each text begins (and the end)."""
    joined = "\0".join(t or "" for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.minimum(codes, 0x3FFFF)
    begins = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    return letter_classes()[codes], begins
