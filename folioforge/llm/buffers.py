"""Words by numpy and Arrow on the UTF-8 buffer of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), and where each begins and the last ends."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    start: np.ndarray  # byte at which each word begins
    code: np.ndarray  # place of each word in ``distinct``
    distinct: pa.Array  # binary


def words_of(data: np.ndarray, is_word: np.ndarray, breaks: np.ndarray) -> Words:
    """Longest runs of bytes of which ``is_word`` (256 booleans) is true; a word
    never crosses ``breaks`` (ascending places in ``data``).

    Separators are ASCII, so words are whole characters.  Words and the gaps
    between them are one Arrow array without a copy of the text; equal words are
    found by Arrow's hash table, exactly.
    """
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[breaks] = True
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    offsets = np.stack([start, end], 1).ravel().astype(np.int64)
    if not len(start):
        return Words(start, np.zeros(0, np.int32), pa.array([], pa.large_binary()))
    runs = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = runs.take(pa.array(np.arange(0, len(runs), 2))).dictionary_encode()
    return Words(start, coded.indices.to_numpy(), coded.dictionary)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists of so many of the ``values`` each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
