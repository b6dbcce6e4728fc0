"""Words of many texts at once, from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts at a time: working on them takes about twenty times as much.
STEP = 1_000_000


def steps(texts: pa.Array, step: int = STEP) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about `step` bytes, with their place; a longer text is a slice of its own."""
    wide = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(wide), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - wide[at] + step, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each begins and the last ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((data - np.uint8(65)) < 26, data + np.uint8(32), data)


def cut(data: np.ndarray, docs: np.ndarray, shown: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The runs of shown bytes as words, and where each begins; none crosses the border of two texts."""
    begins = shown.copy()
    begins[1:] &= ~shown[:-1]
    edges = docs[:-1][docs[:-1] < len(data)]
    begins[edges] = shown[edges]
    at = np.flatnonzero(begins)
    upto = np.cumsum(shown)  # with the byte itself, which is shown where a word begins
    offsets = np.append(upto[at] - 1, upto[-1:] if len(upto) else 0).astype(np.int64)
    del upto, begins
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[shown].tobytes())), at


def ascii_words(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and each text's number of words."""
    data, docs = buffers(texts)
    data = lowered(data)
    words, at = cut(data, docs, (data != 32) & ((data - np.uint8(9)) > 4))
    return words, np.diff(np.searchsorted(at, docs))
