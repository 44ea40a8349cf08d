"""Fill-in-middle transformation by a numpy kernel on whole Arrow batches.

The kernel works on the UTF-8 buffer of a batch, not on strings.  A table gives
each byte its class; a mask over adjacent bytes marks where a unit (line, word,
character) begins; cumulative sums of the mask, less their value before each
document, count units; ``searchsorted`` finds the bytes of all cuts of all rows
at once, and one gather writes all outputs.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import bytes_of
from .common import text_slices

#: Prefix, suffix, middle.
MARKS = ("<P>", "<S>", "<M>")
SLICE_BYTES = 2 << 20
#: Pieces from this length on are copied as such, shorter ones by index.
LONG_PIECE = 1 << 14


def _table(classes: dict[int, str]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for k, members in classes.items():
        out[np.frombuffer(members.encode("latin-1"), np.uint8)] = k
    return out


#: Unit: class of each byte, and whether a unit begins at a byte of class [1] after one of class [0].
UNITS = {
    "line": (_table({1: "\n"}), np.array([[False, False], [True, True]])),
    "word": (_table({1: " \t\n\r\f\v"}), np.array([[False, False], [True, False]])),
    "character": (_table({1: "".join(map(chr, range(0x80, 0xC0)))}), np.array([[True, False], [True, False]])),
}


def _find(data: np.ndarray, word: bytes) -> np.ndarray:
    """Where ``word`` begins, ascending."""
    at = np.flatnonzero(data[: max(0, len(data) - len(word) + 1)] == word[0])
    for k, x in enumerate(word[1:], 1):
        at = at[data[at + k] == x]
    return at


def _gather(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Strings made of the pieces ``source[start : start + length]`` of each row."""
    flat_start, flat = start.ravel(), length.ravel()
    dest = np.cumsum(flat) - flat
    out = np.empty(int(flat.sum()), np.uint8)
    for i in np.flatnonzero(flat >= LONG_PIECE):
        out[dest[i] : dest[i] + flat[i]] = source[flat_start[i] : flat_start[i] + flat[i]]
    short = np.where(flat < LONG_PIECE, flat, 0)
    step = np.arange(int(short.sum())) - np.repeat(np.cumsum(short) - short, short)
    out[np.repeat(dest, short) + step] = source[np.repeat(flat_start, short) + step]
    rows = np.concatenate([[0], np.cumsum(length.sum(axis=1))])
    kind, width = (pa.string(), np.int32) if rows[-1] < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(length), [None, pa.py_buffer(rows.astype(width)), pa.py_buffer(out)])


def transform_batch(texts: pa.Array, h: list[np.ndarray], unit: str, plain_from: int, spm_below: int, marks: tuple[str, ...]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output for one batch; ``h``: four
    arrays of numbers that decide each row."""
    data, at = bytes_of(texts)
    lo, hi = at[:-1], at[1:]
    classes, begins = UNITS[unit]
    kind = classes[data]
    mask = np.zeros(len(data), bool)
    mask[1:] = begins[kind[:-1], kind[1:]]
    mask[lo[lo < hi]] = True
    # up to each byte, over the whole batch; a document's own count starts at its first byte
    units = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    n = (units[hi] - units[lo]).astype(np.int64)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    cut = [np.minimum(np.searchsorted(units[1:], units[lo] + x + 1), hi) for x in (np.minimum(a, b), np.maximum(a, b))]
    plain = (lo == hi) | (h[2] % 100 >= plain_from)
    for m in marks:
        word = m.encode()
        found = _find(data, word)
        row = np.searchsorted(lo, found, "right") - 1
        plain[row[found + len(word) <= hi[row]]] = True
    spm = h[3] % 100 < spm_below
    source = np.concatenate([data, np.frombuffer("".join(marks).encode(), np.uint8)])
    sizes = [len(m.encode()) for m in marks]
    zero = np.zeros(len(lo), np.int64)
    p, s, m = ((zero + len(data) + sum(sizes[:k]), zero + sizes[k]) for k in range(3))
    prefix, middle, suffix = (lo, cut[0] - lo), (cut[0], cut[1] - cut[0]), (cut[1], hi - cut[1])
    orders = {False: (p, prefix, s, suffix, m, middle), True: (s, suffix, p, prefix, m, middle)}
    start, length = (np.where(spm[:, None], np.stack([x[i] for x in orders[True]], 1), np.stack([x[i] for x in orders[False]], 1)) for i in (0, 1))
    start[plain], length[plain] = 0, 0
    start[plain, 0], length[plain, 0] = lo[plain], (hi - lo)[plain]
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    chars = [pa.array((points[y] - points[x]).astype(np.int64), pa.int64(), mask=plain) for x, y in ((lo, cut[0]), (cut[0], cut[1]))]
    return [pa.array(n), form, *chars, _gather(source, start, length)]


def restore_batch(outputs: pa.Array, forms: pa.Array, marks: tuple[str, ...]) -> pa.Array:
    """The texts from which ``outputs`` were made."""
    data, at = bytes_of(outputs)
    lo, hi = at[:-1], at[1:]
    form = np.array(forms.to_pylist(), object)
    spm, plain = form == "spm", (form != "spm") & (form != "psm")
    first, size = [], [len(m.encode()) for m in marks]
    for m in marks:
        found = np.append(_find(data, m.encode()), len(data))
        first.append(found[np.searchsorted(found, lo)])
    p, s, m = first
    head, tail = np.where(spm, p, lo) + size[0], np.where(spm, lo, s) + size[1]
    pieces = [(head, np.where(spm, m, s) - head), (m + size[2], hi - m - size[2]), (tail, np.where(spm, p, m) - tail)]
    start, length = (np.stack([x[i] for x in pieces], 1) for i in (0, 1))
    start[plain], length[plain] = 0, 0
    start[plain, 0], length[plain, 0] = lo[plain], (hi - lo)[plain]
    return _gather(data, start, length)


def _checked(marks: tuple[str, ...]) -> tuple[str, ...]:
    """Marks that can be told apart: none begins inside another or itself."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks overlap: {a!r}, {b!r}")
    return marks


def _numbers(doc_id: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every text with its middle moved to the end.

    Columns: doc_id, n (units of the text), form (plain, psm, spm), prefix_chars,
    middle_chars (code points; null if plain), output.  Numbers h1 to h4 of the
    SHA-256 of ``seed:doc_id`` (nothing after the colon for a null id) decide:
    cuts after h1 % (n + 1) and h2 % (n + 1) units, plain if h3 % 100 >=
    ``fim_percent``, spm if h4 % 100 < ``spm_percent``.  A null text counts as
    empty; empty texts and those with a mark in them are plain.  Rows are
    independent: repeated rows give equal results, an empty table an empty one.
    A worker holds about twenty times a slice of two megabytes of text, or of
    the longest text.
    """
    marks = _checked(tuple(marks))
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, SLICE_BYTES):
            h = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *transform_batch(b.column(1), h, unit, fim_percent, spm_percent, marks)], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.select("doc_id", "text", *_numbers(F.col("doc_id"), seed)).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``rows`` of ``fill_in_middle`` with the column restored: the exact texts,
    rebuilt from output and form alone."""
    marks = _checked(tuple(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "output", SLICE_BYTES):
            form, output = (b.column(b.schema.get_field_index(c)) for c in ("form", "output"))
            yield pa.RecordBatch.from_arrays([*b.columns, restore_batch(output, form, marks)], [*b.schema.names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, restored string")
