"""Benchmark decontamination: BM25 over the test items with block-max WAND.

Test items are cut into units of at most ``UNIT`` words and indexed.  A training
document is a sequence of passages of ``2 * UNIT`` words that start every
``UNIT`` words, so a copy of a unit lies whole in some passage.  A passage is a
query; a unit's score is BM25 divided by the score of the unit against itself,
so 1 means that every word of the unit occurs.  All units that reach ``THETA``
are retrieved, and their items are verified on five-word shingles: the whole
item, or question and answer each, must occur in the document to ``PERCENT``.

No passage may reach THETA where the parts of an item stand apart and are edited.
So the rarest shingles of the whole item, and of its question (or the answer, if
that is longer and the question has no shingle of five words), are indexed too:
one more than may be missing.  A document that is verified holds one of them,
wherever its parts are; with the retrieved units no item is lost.

An item of fewer than five words is one shingle: it must occur as it stands, all
its words in a row (so a one-word item is in every document with that word).

Most passages hold nothing.  Per unit the commonest words, up to half of THETA,
are set aside; a passage can reach THETA only if the other (essential) words add
up to the rest.  That bound is computed for whole batches at a time, and only
passages that pass it run the WAND loop.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UNSPACED, materialize, text_slices

K1, B = 1.2, 0.75
UNIT, THETA = 64, 0.5
SHINGLE, PERCENT = 5, 80
BLOCK = 32
#: Odd factors of a shingle's hash, by position; bits of its table.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
TABLE_BITS = 20
#: Text of one shard of the index; a larger benchmark is searched in several passes.
SHARD_BYTES = 8 << 20
#: Shards that are broadcast together and searched in one pass over the documents.
AT_ONCE = 4
#: In scripts written without spaces (UNSPACED) a character is a word.
WORD = re.compile(rf"(?=[^\W_])[{UNSPACED}]|[^\W_{UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """k-word shingles; of fewer words all of them as one."""
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


@dataclass
class Item:
    item_id: int
    whole: set
    question: set
    answer: set


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line is the answer, if there are several."""
    lines = [x for x in text.split("\n") if x.strip()]
    return ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else (text, "")


class Index:
    """Impact-ordered statistics of the units, posting lists in blocks.

    ``weights`` are normalised impacts; list t has units ``units[t]`` ascending,
    ``weights[t]``, and for every block of BLOCK postings its last unit and
    largest weight.
    """

    def __init__(self, rows: list[tuple[int, str]], df: Counter | None = None, n_units: int | None = None, mean: float | None = None):
        self.items: list[Item] = []
        self.item_of: list[int] = []
        bags: list[list[str]] = []
        for item_id, text in rows:
            w = words_of(text)
            if not w:
                continue
            q, a = (shingles(words_of(x)) for x in split_item(text))
            for part in cut_units(w):
                bags.append(part)
                self.item_of.append(len(self.items))
            self.items.append(Item(item_id, shingles(w), q, a))
        if df is None:
            df = Counter(t for b in bags for t in set(b))
        n_units = n_units or len(bags)
        mean = mean or sum(map(len, bags)) / max(1, len(bags))
        self.ids = {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        essential: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        self.need = np.zeros(len(bags))
        for u, bag in enumerate(bags):
            impact = {}
            for t, f in Counter(bag).items():
                idf = math.log(1 + (n_units - df[t] + 0.5) / (df[t] + 0.5))
                impact[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(bag) / mean))
            total = sum(impact.values())
            spare, aside = THETA / 2, 0.0
            for t in sorted(impact, key=lambda t: (-df[t], len(t), t)):
                w = impact[t] / total
                lists[self.ids[t]].append((u, w))
                if aside + w <= spare:
                    aside += w
                else:
                    spare = -1.0
                    essential[self.ids[t]].append((u, w))
            self.need[u] = THETA - aside - 1e-9
        self.units = [[u for u, _ in x] for x in lists]
        self.weights = [[w for _, w in x] for x in lists]
        self.last = [x[BLOCK - 1 :: BLOCK] + ([x[-1]] if len(x) % BLOCK else []) for x in self.units]
        self.most = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.weights]
        self.top = [max(w) for w in self.weights]
        # essential postings, one after the other
        self.start = np.cumsum([0, *map(len, essential)])
        self.e_unit = np.array([u for x in essential for u, _ in x], np.int64)
        self.e_weight = np.array([w for x in essential for _, w in x])
        self.count = np.diff(self.start)
        self._index_shingles(df)

    def _index_shingles(self, df: Counter) -> None:
        """By size of shingle: sorted hashes, their item numbers, and a table of the hashes' first bits."""
        keys: dict[int, set[tuple[int, int]]] = {}
        for i, x in enumerate(self.items):
            size = lambda part: (len(next(iter(part))), len(part)) if part else (0, 0)
            parts = [x.whole]
            if x.question and x.answer:
                q, a = size(x.question), size(x.answer)
                parts.append(x.answer if q[0] < SHINGLE and a > q else x.question)
            for part in parts:
                rare = sorted(part, key=lambda g: (min(df[t] for t in g), g))[: len(part) * (100 - PERCENT) // 100 + 1]
                ids = np.array([[self.ids[t] for t in g] for g in rare], np.int64)
                keys.setdefault(ids.shape[1], set()).update((h, i) for h in _hashes(ids.ravel(), ids.shape[1])[:: ids.shape[1]].tolist())
        self.shingled = {}
        for k, pairs in keys.items():
            pairs = sorted(pairs)
            h = np.array([x for x, _ in pairs], np.uint64)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[h >> np.uint64(64 - TABLE_BITS)] = True
            self.shingled[k] = h, np.array([i for _, i in pairs], np.int64), table

    def sharing(self, ids: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item number) where the document may hold an indexed shingle of the item."""
        out = set()
        for k, (keys, items, table) in self.shingled.items():
            if len(ids) < k:
                continue
            h = _hashes(ids, k)
            at = np.flatnonzero(table[h >> np.uint64(64 - TABLE_BITS)])
            first, end = (np.searchsorted(keys, h[at], side) for side in ("left", "right"))
            hit = np.flatnonzero(end > first)
            doc = np.searchsorted(starts, at[hit], side="right") - 1
            for d, a, e in set(zip(doc.tolist(), first[hit].tolist(), end[hit].tolist())):
                out.update((d, i) for i in items[a:e].tolist())
        return out

    def best_score(self, ids: np.ndarray, item: int) -> float:
        """The largest score of a unit of the item over all passages of one document."""
        best = 0.0
        held = [t for t in np.unique(ids).tolist() if t >= 0]
        for unit in range(bisect_left(self.item_of, item), bisect_left(self.item_of, item + 1)):
            weight = {}
            for t in held:
                p = bisect_left(self.units[t], unit)
                if p < len(self.units[t]) and self.units[t][p] == unit:
                    weight[t] = self.weights[t][p]
            at = np.flatnonzero(np.isin(ids, list(weight)))
            for block in np.unique(at // UNIT).tolist():
                for start in (max(0, block - 1) * UNIT, block * UNIT):
                    inside = ids[at[np.searchsorted(at, start) : np.searchsorted(at, start + 2 * UNIT)]]
                    best = max(best, sum(weight[t] for t in np.unique(inside).tolist()))
        return best

    def wand(self, terms: list[int], theta: float = THETA) -> dict[int, float]:
        """Every unit whose score against ``terms`` reaches ``theta``: block-max WAND."""
        end = len(self.item_of)
        lists = [[0, self.units[t][0], t] for t in terms]  # position, unit, term
        out: dict[int, float] = {}
        theta -= 1e-9

        def seek(x: list, unit: int) -> None:
            units = self.units[x[2]]
            p = x[0] = bisect_left(units, unit, x[0])
            x[1] = units[p] if p < len(units) else end

        while True:
            lists.sort(key=lambda x: x[1])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                if x[1] >= end:
                    break
                bound += self.top[x[2]]
                if bound >= theta:
                    pivot = k
                    break
            if pivot < 0:
                return out
            unit = lists[pivot][1]
            while pivot + 1 < len(lists) and lists[pivot + 1][1] == unit:
                pivot += 1
            # the bound of the blocks that hold the pivot, and where the first of them ends
            bound, border = 0.0, end - 1
            for x in lists[: pivot + 1]:
                k = bisect_left(self.last[x[2]], unit)
                if k < len(self.last[x[2]]):
                    bound += self.most[x[2]][k]
                    border = min(border, self.last[x[2]][k])
            if bound < theta:
                after = border + 1
                if pivot + 1 < len(lists):
                    after = min(after, lists[pivot + 1][1])
                for x in lists[: pivot + 1]:
                    if x[1] < after:
                        seek(x, max(after, unit + 1))
                continue
            if lists[0][1] == unit:
                score = sum(self.weights[x[2]][x[0]] for x in lists[: pivot + 1])
                if score >= theta:
                    out[unit] = score
                for x in lists[: pivot + 1]:
                    seek(x, unit + 1)
            else:
                for x in lists[:pivot]:
                    if x[1] < unit:
                        seek(x, unit)

    def passages(self, ids: np.ndarray, length: list[int]) -> Iterator[tuple[int, int]]:
        """(document, start word) of the passages whose bound reaches THETA.

        ``ids``: the term numbers of all documents one after the other, -1 for
        words that no item has; ``length``: the words of each document.
        """
        if not len(self.e_unit) or not len(ids):
            return
        n_blocks = np.array([-(-n // UNIT) + 1 for n in length])  # one more keeps documents apart
        offset = np.concatenate([[0], np.cumsum(n_blocks)[:-1]])
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])
        hit = np.flatnonzero(ids >= 0)
        hit = hit[self.count[ids[hit]] > 0]
        if not len(hit):
            return
        doc = np.searchsorted(starts, hit, side="right") - 1
        block = offset[doc] + (hit - starts[doc]) // UNIT
        key = np.unique(block * len(self.ids) + ids[hit])
        block, term = np.divmod(key, len(self.ids))
        n = self.count[term]
        at = np.repeat(self.start[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pair = np.repeat(block, n) * len(self.item_of) + self.e_unit[at]
        pair, inverse = np.unique(pair, return_inverse=True)
        total = np.bincount(inverse, weights=self.e_weight[at], minlength=len(pair))
        follow = np.searchsorted(pair, pair + len(self.item_of))
        follow[follow == len(pair)] = 0
        total += np.where(pair[follow] == pair + len(self.item_of), total[follow], 0.0)
        block, unit = np.divmod(pair, len(self.item_of))
        found = np.unique(block[total >= self.need[unit]])
        # a bound that is met from this block on may be met from the one before
        for b in np.unique(np.concatenate([found, found - 1])).tolist():
            d = int(np.searchsorted(offset, b, side="right") - 1)
            if b >= 0 and (b - offset[d]) * UNIT < length[d]:
                yield d, int(b - offset[d]) * UNIT

    def search(self, texts: list[str | None]) -> list[dict[int, tuple]]:
        """For each text: item number -> (score, overlap, question, answer)."""
        docs = [words_of(t) for t in texts]
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for d in docs for w in d), dtype=np.int64, count=sum(map(len, docs)))
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(int)
        candidates: list[dict[int, float]] = [{} for _ in texts]
        for d, at in self.passages(ids, [len(x) for x in docs]):
            window = ids[starts[d] + at : min(starts[d] + at + 2 * UNIT, starts[d + 1])]
            for unit, score in self.wand(np.unique(window[window >= 0]).tolist()).items():
                i = self.item_of[unit]
                candidates[d][i] = max(score, candidates[d].get(i, 0.0))
        for d, i in self.sharing(ids, starts):
            candidates[d].setdefault(i, -1.0)
        found = [self._verified(docs[d], c) if c else {} for d, c in enumerate(candidates)]
        for d, held in enumerate(found):
            for i, (score, *overlaps) in held.items():
                if score < 0:
                    held[i] = (self.best_score(ids[starts[d] : starts[d + 1]], i), *overlaps)
        return found

    def _verified(self, words: list[str], candidates: dict[int, float]) -> dict[int, tuple]:
        by_size: dict[int, set] = {}

        def overlap(part: set) -> float | None:
            if not part:
                return None
            k = len(next(iter(part)))
            if k not in by_size:
                by_size[k] = shingles(words, k)
            return len(part & by_size[k]) / len(part)

        out = {}
        for i, score in candidates.items():
            x = self.items[i]
            whole, q, a = overlap(x.whole), overlap(x.question), overlap(x.answer)
            if 100 * whole >= PERCENT or (a is not None and q is not None and 100 * q >= PERCENT and 100 * a >= PERCENT):
                out[i] = (score, whole, q, a)
        return out


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k ids from each place on."""
    x, n = ids.astype(np.uint64) + np.uint64(1), len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += x[j : n + j] * FACTORS[j]
    return h


def cut_units(words: list[str]) -> list[list[str]]:
    n = max(1, math.ceil(len(words) / UNIT))
    size = max(1, math.ceil(len(words) / n))
    return [words[i : i + size] for i in range(0, len(words), size)]


def build_shards(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """Indexes of at most about ``shard_bytes`` of text each, with common statistics.

    A benchmark is gathered one shard at a time.  Repeated items are separate
    items; items without words are left out.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / shard_bytes))
    if n == 1:
        yield Index(sorted(map(tuple, rows.collect()), key=repr))
        return
    shard = lambda i: sorted(map(tuple, rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()), key=repr)
    df: Counter = Counter()
    units = words = 0
    for i in range(n):
        for _, text in shard(i):
            for u in cut_units(words_of(text)):
                df.update(set(u))
                units, words = units + 1, words + len(u)
    for i in range(n):
        yield Index(shard(i), df, units, words / max(1, units))


PAIRS = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def contaminated_pairs(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every document with every test item that it holds: doc_id, item_id, score,
    overlap, question_overlap, answer_overlap (null without an answer line)."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for held in _broadcast(docs.sparkSession, items, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches, "text", 1 << 20):
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                rows = [(i, index.items[k].item_id, *v) for index in held.value for i, found in zip(ids, index.search(texts)) for k, v in sorted(found.items())]
                kinds = [pa.int64()] * 2 + [pa.float64()] * 4
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in PAIRS.split(", ")])

        found = picked.mapInArrow(run, PAIRS)
        out = found if out is None else out.union(found)
    return out


def _broadcast(spark: SparkSession, items: DataFrame, shard_bytes: int) -> Iterator:
    """Broadcasts of up to AT_ONCE indexes each."""
    for shards in batched(build_shards(items, shard_bytes), AT_ONCE):
        yield spark.sparkContext.broadcast(shards)


def flag_contaminated(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (ascending), max_score.

    Null or empty texts hold nothing.  Rows that repeat a doc_id all get what any
    of them holds.  Without items nothing is contaminated; max_score is null
    where nothing is found.
    """
    pairs = materialize(contaminated_pairs(docs, items, shard_bytes), "leaks")
    held = pairs.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("max_score"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    none = F.array().cast("array<long>")
    return ids.join(held, ids["doc_id"].eqNullSafe(held["__id"]), "left").select(
        "doc_id", F.col("max_score").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.round("max_score", 6).alias("max_score")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a test item; columns unchanged.
    Rows are judged where they are; nothing is shuffled."""
    for held in _broadcast(docs.sparkSession, items, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches, "text", 1 << 20):
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                kept = np.ones(len(texts), bool)
                for index in held.value:
                    at = np.flatnonzero(kept)
                    kept[at] = [not f for f in index.search([texts[i] for i in at.tolist()])]
                yield b.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
