"""Phrase collocations by contiguous pattern growth in the manner of PrefixSpan.

Texts become runs of numbers: a slice of text has its own small dictionary, and a
join gives the words that are frequent in the whole corpus their identifiers (no
dictionary is sent anywhere).  Frequent pairs are counted.  For every occurrence
of a frequent pair that can be extended, the projection is the window of words
that follow, cut at the first infrequent pair; equal windows of a slice travel as
one row with a count.

The windows are dealt out by ranges of their words.  In a sorted range the
projection of a prefix is an interval, so a task grows each of its prefixes to
the right, depth first, by cutting intervals; only prefixes with enough support
are grown.  A prefix with very many windows spans several ranges: each counts its
part, and the parts are summed.  A prefix thus is one task, or as many as its
windows fill, and no task gets more than a range.

Counts, parts and scores are exact; a bitmap that lets an infrequent pair pass
only leads to windows that are counted and then found infrequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import LOWER, bytes_of, words_of
from .common import arrow_rows, bitmap, join_hot, materialize, text_slices

SUPPORT, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Scores count in parts of this many.
SCALE = 2_000_000
SLICE_BYTES, CHUNK = 12 << 20, 2 << 20
#: Rows of an Arrow batch: of texts, and of slices (up to a few megabytes each).
TEXT_ROWS, SLICE_ROWS = 1000, 4
#: Salts of the first rounds of a ranking; each round keeps the best of each salt.
ROUNDS = (1024, 32)
_SEPARATES = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\v\f\r", np.uint8))
_IS_WORD = ~_SEPARATES & ~np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))


# words as numbers -----------------------------------------------------------------


def _chunks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about CHUNK bytes, cut where a text or a piece ends."""
    lo = 0
    while lo < len(data):
        hi = min(lo + CHUNK, len(data))
        text_end = int(at[np.searchsorted(at, hi)])
        while hi < text_end:
            found = np.flatnonzero(_SEPARATES[data[hi : min(hi + CHUNK, text_end)]])
            hi = hi + int(found[0]) if len(found) else min(hi + CHUNK, text_end)
            if len(found):
                break
        yield lo, hi
        lo = hi


def _coded(data: np.ndarray, breaks: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Different words, and the places of all words in them; -1 between pieces."""
    found = words_of(data, _IS_WORD, breaks)
    piece = np.searchsorted(np.flatnonzero(_SEPARATES[data]), found.start) + np.searchsorted(breaks, found.start, "right")
    return found.distinct.cast(pa.binary()).view(pa.string()), np.insert(found.code, np.flatnonzero(piece[1:] != piece[:-1]) + 1, -1).astype(np.int32, copy=False)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined to about SLICE_BYTES, for few slices and few words in them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId() << 32, 0
    for b in text_slices(_gathered(batches), 1, SLICE_BYTES):
        langs = b.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            data, at = bytes_of(b.column(1).filter(pa.array(langs.indices.to_numpy() == k)))
            for lo, hi in _chunks(data, at):
                words, codes = _coded(LOWER[data[lo:hi]], np.append(at[(at > lo) & (at < hi)] - lo, hi - lo))
                if not len(words):
                    continue
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                cols = [pa.array([task + number]), pa.array([lang]), pa.array([int(counts.sum())]), one(words), one(pa.array(counts.astype(np.int64))), pa.array([codes.tobytes()], pa.binary())]
                number += 1
                yield pa.RecordBatch.from_arrays(cols, ["slice", "lang", "n", "words", "counts", "codes"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of frequent words only, numbered anew by ascending identifier."""
    for b in batches:
        for lang, codes, places, ids in zip(*(b.column(k) for k in range(4))):
            codes = np.frombuffer(codes.as_buffer(), np.int32)
            ids, places = ids.values.to_numpy(), places.values.to_numpy()
            order = np.argsort(ids)
            new = np.full(max(int(codes.max()), int(places.max())) + 2, -1, np.int32)  # the last is for -1
            new[places[order]] = np.arange(len(ids))
            out = new[codes]
            keep = np.ones(len(out), bool)
            keep[1:] = (out[1:] >= 0) | (out[:-1] >= 0)  # one break is enough
            cols = [pa.array([lang.as_py()]), pa.array([out[keep].tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids[order]))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "codes", "ids"])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for b in batches:
        for lang, codes, ids in zip(*(b.column(k) for k in range(3))):
            yield lang.as_py(), np.frombuffer(codes.as_buffer(), np.int32), ids.values.to_numpy()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, codes, ids in _rows_of(batches):
        both = (codes[:-1] >= 0) & (codes[1:] >= 0)
        keys, n = np.unique(codes[:-1][both].astype(np.int64) * len(ids) + codes[1:][both], return_counts=True)
        for at in range(0, len(keys), 1 << 17):
            k = keys[at : at + (1 << 17)]
            cols = [pa.array(ids[k // len(ids)]), pa.array(ids[k % len(ids)]), pa.array([lang] * len(k), pa.string()), pa.array(n[at : at + (1 << 17)])]
            yield pa.RecordBatch.from_arrays(cols, ["w1", "w2", "lang", "n"])


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mixed bits of two identifiers."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))).astype(np.int64)


def _keys_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_pair_key(b.column(0).to_numpy(), b.column(1).to_numpy()))], ["key"])


def _windows(longest: int, bits) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for lang, codes, ids in _rows_of(batches):
            own = np.concatenate([codes, np.full(longest, -1, np.int32)])
            last = len(codes)
            both = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
            at = _pair_key(ids[own[both]], ids[own[both + 1]]) & (64 * len(held) - 1)
            follows = np.zeros(len(own), bool)  # the pair that begins here may be frequent
            follows[both[((held[at >> 6] >> (at & 63)) & 1) == 1]] = True
            start = np.flatnonzero(follows[:last] & follows[1 : last + 1])
            rows = np.zeros((len(start), longest), np.int64)
            rows[:, 0] = own[start] + 1
            alive = np.ones(len(start), bool)
            key = rows[:, 0].copy()
            for d in range(1, longest):
                alive &= follows[start + d - 1]
                rows[alive, d] = own[start[alive] + d] + 1
                key = np.unique(key, return_inverse=True)[1] * (len(ids) + 1) + rows[:, d]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            rows = rows[first]
            for lo in range(0, len(rows), 1 << 16):
                part = rows[lo : lo + (1 << 16)]
                sizes = (part > 0).sum(axis=1)
                window = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids[part[part > 0] - 1]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), window, pa.array(n[lo : lo + (1 << 16)])], ["lang", "window", "n"])

    return run


# growth ---------------------------------------------------------------------------


def grow(rows: np.ndarray, n: np.ndarray, support: int, least: int = 3) -> list[tuple[int, int, int]]:
    """(row, depth, count) of the prefixes of at least ``least`` words in sorted
    ``rows`` (0 after a row's last word) with ``support`` or more, and of those
    that reach the first or last row and so may go on in the parts beside this."""
    upto = np.concatenate([[0], np.cumsum(n)])
    out: list[tuple[int, int, int]] = []

    def extend(lo: int, hi: int, depth: int) -> None:
        """The rows lo to hi share ``depth`` words: the projection of that prefix."""
        column = rows[lo:hi, depth]
        lo += int(np.searchsorted(column, 1))  # rows that end here come first
        column = rows[lo:hi, depth]
        if not len(column):
            return
        starts = lo + np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
        ends = np.append(starts[1:], hi)
        counts = upto[ends] - upto[starts]
        for k in np.flatnonzero((counts >= support) | (starts == 0) | (ends == len(rows))).tolist():
            if depth + 1 >= least:
                out.append((int(starts[k]), depth + 1, int(counts[k])))
            if depth + 1 < rows.shape[1]:
                extend(int(starts[k]), int(ends[k]), depth + 1)

    if len(rows):
        extend(0, len(rows), 0)
    return out


def _grown(longest: int, support: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, window, n = b.columns
            at = window.offsets.to_numpy() - window.offsets[0].as_py()
            sizes = np.diff(at)
            rows = np.zeros((len(sizes), longest), np.int64)
            rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(at[-1]) - np.repeat(at[:-1], sizes)] = window.flatten().to_numpy()
            found = grow(rows, n.to_numpy(), support)
            cols = [pa.array([lang[r].as_py() for r, _, _ in found], pa.string()), pa.array([rows[r, :d] for r, d, _ in found], pa.list_(pa.int64())), pa.array([c for *_, c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "n"])

    return run


def _counted_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` with the entry of ``side`` for their ``key`` (one each at most);
    hot keys are not shuffled."""
    needed = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    return join_hot(rows, materialize(side.join(needed, key), "phrase-side"), [key], rows.count()).drop("n_rows")


def _best(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` of each lang with their rank, from the best of ever fewer
    parts, so no task ranks a whole language."""
    for salts in ROUNDS:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("ids"), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, phrases): lang, n; id, lang, word, a; lang, ids, a.

    Phrases have 2 to ``longest`` words and occur ``support`` times or more.
    """
    picked = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = "slice long, lang string, n long, words array<string>, counts array<long>, codes binary"
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        coded = materialize(picked.mapInArrow(_encode, schema), "phrase-slices", long_rows=True)
    totals = coded.groupBy("lang").agg(F.sum("n").alias("n"))
    entries = coded.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("slice", "lang", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    often = entries.groupBy("lang", "word").agg(F.sum("n").alias("a"), F.count("*").alias("n_rows")).where(F.col("a") >= support)
    with arrow_rows(spark, SLICE_ROWS):
        words = materialize(often.withColumn("id", F.monotonically_increasing_id() + 1), "phrase-words")
        n_entries = coded.agg(F.sum(F.size("words"))).first()[0] or 0
    named = join_hot(entries.drop("n"), words.select("lang", "word", "id", "n_rows"), ["lang", "word"], n_entries)
    # bounded by the words of a slice
    named = named.groupBy("slice").agg(F.collect_list(F.struct("place", "id")).alias("x")).select("slice", F.col("x.place").alias("places"), F.col("x.id").alias("ids"))
    spelled = coded.select("slice", "lang", "codes").join(named, "slice").select("lang", "codes", "places", "ids").mapInArrow(_spell, "lang string, codes binary, ids array<long>")
    with arrow_rows(spark, SLICE_ROWS):
        spelled = materialize(spelled, "phrase-spelled", long_rows=True)
    # a slice has counted its pairs; few of them are in the next slice, so nothing is gained by summing before the shuffle
    pairs = spelled.mapInArrow(_pairs, "w1 long, w2 long, lang string, n long").repartition("lang", "w1", "w2")
    pairs = pairs.groupBy("lang", "w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= support)
    with arrow_rows(spark, SLICE_ROWS):
        pairs = materialize(pairs, "phrase-pairs")
    phrases = pairs.select("lang", F.array("w1", "w2").alias("ids"), "a")
    if longest > 2:
        keys = pairs.select("w1", "w2").mapInArrow(_keys_of_pairs, "key long")
        bits = np.array(bitmap(keys, pairs.count(), "phrase-bitmap").first().bits, np.int64)  # at most four megabytes
        sent = spark.sparkContext.broadcast(bits)
        with arrow_rows(spark, SLICE_ROWS):
            windows = materialize(spelled.mapInArrow(_windows(longest, sent), "lang string, window array<long>, n long"), "phrase-windows")
        ranges = windows.repartitionByRange("window").sortWithinPartitions("window")
        grown = ranges.mapInArrow(_grown(longest, support), "lang string, phrase array<long>, n long")
        grown = grown.groupBy("lang", F.col("phrase").alias("ids")).agg(F.sum("n").alias("a")).where(F.col("a") >= support)
        phrases = phrases.unionByName(grown)
    return totals, words, materialize(phrases, "phrases")


def mine_collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, cover: int = COVER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` collocations of each language.

    Columns: lang, rank (from 1), phrase, a, l, r, n, score.  Texts are lower-cased
    (A-Z), split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and at blanks and tabs into
    words; phrases of 2 to ``longest`` words are counted within pieces, overlaps
    included; n: all words of the language.  Candidates occur ``support`` times
    or more; the cut after k words with the lowest score floor(2000000 a / (l + r))
    counts, ties to the smallest k.  A candidate inside a longer one that has
    ``cover`` per cent of its occurrences or more is left out.  Ranks go by score
    and a descending, then by the phrase's bytes.  Null lang is ``und``, null text
    empty; repeated rows count each; an empty table gives an empty result.  A
    worker holds some twenty times a chunk of two megabytes of text (or of the
    longest run without punctuation).
    """
    totals, words, phrases = frequent_phrases(docs, support, longest, lang_col, text_col)
    size = F.size("ids")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.slice("ids", 1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), F.slice("ids", F.col("k") + 1, size).alias("part")))).alias("x")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "ids", "a", "k", sides).select("lang", "ids", "a", "k", "x.side", "x.part")
    known = words.select(F.array("id").alias("part"), F.col("a").alias("f")).unionByName(phrases.where(size < longest).select(F.col("ids").alias("part"), F.col("a").alias("f")))
    of_part = _counted_join(materialize(cuts, "phrase-cuts"), known, "part")
    of_cut = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("f")))
    both = of_part.groupBy("lang", "ids", "a").agg(*(of_cut(s, k).alias(f"{c}{k}") for k in range(1, longest) for s, c in enumerate("lr")))
    score = "CAST(a AS DECIMAL(20,0)) * {scale} div (CAST(l{k} AS DECIMAL(20,0)) + CAST(r{k} AS DECIMAL(20,0)))"
    each_cut = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(score.format(scale=SCALE, k=k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    scored = both.withColumn("cut", F.array_min(F.array_compact(F.array(*each_cut)))).select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")
    inside = [F.when((F.lit(m) < size) & (F.lit(s + m) <= size), F.slice("ids", s + 1, m)) for m in range(2, longest) for s in range(longest - m + 1)]
    if inside:
        longer = phrases.where(size > 2).select("a", F.explode(F.array_compact(F.array(*inside))).alias("ids")).groupBy("ids").agg(F.max("a").alias("within"))
        scored = scored.join(longer, "ids", "left").where(F.col("within").isNull() | (_exact("within") * 100 < _exact("a") * cover)).drop("within")
    scored = materialize(scored, "phrase-scores")
    # words are looked up only for what may be among the first, ties included
    value = [F.desc("score"), F.desc("a")]
    limit = _best(scored.select("lang", "ids", "score", "a"), value, top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    sizes = scored.groupBy("lang").agg(F.count("*").alias("n_rows"))
    may = join_hot(scored, materialize(limit.join(sizes, "lang"), "phrase-limits"), ["lang"], scored.count()).where(F.struct("score", "a") >= F.col("least")).drop("least", "n_rows")
    may = materialize(may, "phrase-best")
    each = may.select("ids", F.posexplode("ids").alias("place", "id"))
    text = _counted_join(each, words.select("id", "word"), "id").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("x"))
    whole = may.join(text.select("ids", F.array_join(F.col("x.word"), " ").alias("phrase")), "ids")
    ranked = _best(whole, [*value, F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
