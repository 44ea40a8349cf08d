"""Exact dedup by a tree merge of sorted digest runs.

Every input partition digests its texts, sorts the digests and owns a run of
(digest, keeper, count).  Runs are then exchanged in rounds between as many
slots as there are partitions: in round *j* a slot cuts its run by digit *j* of
the digest and sends each piece to the slot that differs from itself in that
digit alone, so it talks to at most ``2**BITS`` others, and after the last round
slot *s* holds exactly the digests whose digits spell *s*.  A slot is a shuffle
partition.  What reaches it are sorted runs; Spark's sorter, which takes sorted
stretches as they are, merges them (spilling if need be), and one pass over the
merged run collapses equal digests into the entry with the best identifier.

Each level verifies what it retains: entries are equal only if digest, a second
digest and the length agree, the run must ascend, and its digests must belong to
the slot; anything else stops the job.  A group of copies, however large, is one
entry per run after the first level, and no slot ever holds more than its share
of the *distinct* digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, keep_rows, materialize, row_key, text_slices

#: Bits of a digit: eight runs meet in a round.
BITS = 3
RUN = "doc_id long, k1 long, k2 long, n_cp long, digest binary, check long, n_norm long"
GROUP = ["digest", "check", "n_norm"]
#: The best identifier comes first: most code points, then the smallest doc_id.
ORDER = [*GROUP, "neg_cp", "no_id", "doc_id", "k1", "k2"]
ENTRY = "slot int, digest binary, check long, n_norm long, neg_cp long, no_id boolean, doc_id long, k1 long, k2 long, size long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha, second = hashlib.sha256, xxhash.xxh3_64_intdigest
    for b in text_slices(batches, 3):
        n_cp, digest, check, n_norm = [], [], [], []
        for text in b.column(3).to_pylist():
            text = text or ""
            # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
            norm = b"".join(text.encode("utf-8").split())
            n_cp.append(len(text))
            digest.append(sha(norm).digest())
            check.append(second(norm) - (1 << 63))
            n_norm.append(len(norm))
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array(n_cp, pa.int64()), pa.array(digest, pa.binary()), pa.array(check, pa.int64()), pa.array(n_norm, pa.int64())],
            [f.split()[0] for f in RUN.split(", ")],
        )


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, k1, k2 (the row's key), n_cp (code points),
    digest (SHA-256 of the text without white space), check (another digest of
    it), n_norm (its bytes)."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc_id.alias("doc_id"), *row_key(doc_id, text), text.alias("text")).mapInArrow(_digests, RUN)


def _leading(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The digests as rows of bytes, and their first four bytes as numbers."""
    fixed = digests.cast(pa.binary(32))
    raw = np.frombuffer(fixed.buffers()[1], np.uint8, count=32 * len(fixed), offset=32 * fixed.offset).reshape(-1, 32)
    return raw, raw[:, :4].copy().view(">u4")[:, 0].astype(np.int64)


def _collapse(low: int, high: int):
    """Merge level: entries sorted by ORDER -> one per group, with the slot they
    go to next, which has bits ``low`` to ``high`` from the digest.  The bits
    below ``low`` must be those of the digest already."""
    names = [f.split()[0] for f in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.RecordBatch.from_arrays(b.columns, names)
            if held is not None:
                b = pa.concat_batches([held, b])
            raw, number = _leading(b.column(1))
            slot = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if ((slot ^ number) & ((1 << low) - 1)).any():
                raise RuntimeError("a digest has reached a slot that is not its own")
            unlike = (raw[1:] != raw[:-1]).any(axis=1)
            first = np.flatnonzero(unlike)
            at = (raw[1:] != raw[:-1]).argmax(axis=1)[first]
            if (raw[first + 1, at] < raw[first, at]).any():
                raise RuntimeError("a run of digests does not ascend")
            for k in (2, 3):
                x = b.column(k).to_numpy()
                unlike |= x[1:] != x[:-1]
            start = np.concatenate([[0], np.flatnonzero(unlike) + 1])
            size = np.add.reduceat(b.column(9).to_numpy(), start)
            mask = (1 << high) - 1
            due = (slot[start] & ~mask) | (number[start] & mask) if high > low else slot[start]
            rows = b.take(pa.array(start))
            rows = pa.RecordBatch.from_arrays([pa.array(due, pa.int32()), *rows.columns[1:9], pa.array(size, pa.int64())], names)
            yield rows.slice(0, len(start) - 1)
            # the last group may go on in the next batch, in this slot
            last = rows.slice(len(start) - 1)
            held = pa.RecordBatch.from_arrays([pa.array(slot[-1:], pa.int32()), *last.columns[1:]], names)
            tail = last
        if held is not None:
            yield tail

    return run


def levels(runs: DataFrame, bits: int = BITS) -> Iterator[DataFrame]:
    """The entries after each level of the tree; slots are partitions."""
    width = max(1, (runs.rdd.getNumPartitions() - 1).bit_length())
    slots, cuts = 1 << width, [*range(0, width, bits), width]
    level = runs.select(
        F.pmod(F.spark_partition_id(), F.lit(slots)).cast("int").alias("slot"),
        *GROUP,
        (-F.col("n_cp")).alias("neg_cp"),
        F.col("doc_id").isNull().alias("no_id"),
        "doc_id",
        "k1",
        "k2",
        F.lit(1).cast("long").alias("size"),
    )
    for low, high in zip(cuts, cuts[1:]):
        level = level.sortWithinPartitions(*ORDER).mapInArrow(_collapse(low, high), ENTRY).repartitionById(slots, "slot")
        yield level
    yield level.sortWithinPartitions(*ORDER).mapInArrow(_collapse(width, width), ENTRY)


def tree_merge(runs: DataFrame, bits: int = BITS) -> DataFrame:
    """Groups of equal texts: digest, check, n_norm, keep_id, best_cp, best_k1,
    best_k2 (of the row that stays), n_rows.

    The keeper of a group has the most code points, then the smallest
    identifier (null last); rows that agree in both are told apart by their key.
    """
    *_, last = levels(runs, bits)
    return last.select(*GROUP, F.col("doc_id").alias("keep_id"), (-F.col("neg_cp")).alias("best_cp"), F.col("k1").alias("best_k1"), F.col("k2").alias("best_k2"), F.col("size").alias("n_rows"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Every row of the runs with its group; the rows of a hot group stay where
    they are."""
    runs = materialize(digest_runs(docs, id_col, text_col), "digest-runs")
    groups = materialize(tree_merge(runs, bits), "digest-groups")
    return join_hot(runs, groups, GROUP, runs.count())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Group documents whose texts are equal after deleting ``[\\x20\\x09-\\x0D]``.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256.  Null text = empty text; all empty texts are one group.  Ties in
    length go to the smallest doc_id; a null doc_id is chosen only in a group
    without any other.  Rows that repeat the keeper's doc_id, length and text
    are all marked kept, since an identifier cannot tell them apart, and each
    counts in group_size.  An empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col, bits).select(
        "doc_id",
        "keep_id",
        F.col("n_rows").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("best_cp"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts; columns unchanged.

    Decided on rows, not on identifiers: where a doc_id repeats, its other texts
    are not touched, and of rows equal in doc_id and text one stays.
    """
    stays = (F.col("k1") == F.col("best_k1")) & (F.col("k2") == F.col("best_k2"))
    return keep_rows(docs, _grouped(docs, "doc_id", "text", BITS).select("k1", "k2", stays.alias("stays")))
