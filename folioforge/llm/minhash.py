"""Near-duplicate components by b-bit MinHash.

1. One pass over the texts makes, per document, the set of word shingles, a key
   of the whole set, ``BANDS`` band keys of ``ROWS`` minima each, and a packed
   signature with the two low bits of ``PERMS`` minima.
2. Documents with equal sets collapse to their smallest identifier.
3. Band keys that at least two sets share are buckets.  Every member is paired
   with the bucket's smallest member, the similarity is estimated from the
   signatures by counting bits (corrected for chance collisions), and pairs that
   may reach the threshold are confirmed on the full sets.  This is linear in
   the members and joins dense groups.
4. Only buckets that still hold several components go on.  In those larger than a
   block, members first meet ``CENTRES`` more of the bucket, which is linear too and
   joins most of a large group of near copies.  What still differs is compared,
   every pair in one bucket only (that of its first shared
   band) and only between different components; what passes the estimate is
   confirmed on the full sets inside the task.  No pairs are written, only the
   links that join components.
5. Blocks cost the square of a bucket's members, so buckets that don't fit one task
   (more than ``GIANT`` members or ``BLOCK_SHINGLES``; pages of one template, say) are
   left out of the comparison in step 4: no text is dealt twice for a bucket.  Most
   of their links show up in smaller buckets; for the rest their members go through
   an exact filter on the full sets (see :func:`_prefix_rows`), whose candidates
   share a rare shingle early enough to reach the threshold.
6. Components of the confirmed links give the result.

Sets, not identifiers, are what is linked; a set is known by a number that it
gets when the table of sets is written.

A pair at the threshold of 0.85 (0.8) shares no band with a probability of
1e-10 (4e-8); the estimate lets through what lies within five standard
deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, keep_rows, materialize, row_key, text_slices
from .components import connected_components

PERMS, BITS, ROWS, BANDS = 128, 2, 3, 24
LONGS = PERMS * BITS // 64
SLACK = 5.0
#: Members of a block, shingles of a bucket whose texts meet in one task, and members a centre meets in one.
BLOCK_ROWS, BLOCK_SHINGLES, CHUNK = 500, 500_000, 256
#: Members of a mixed bucket larger than a block that all others are compared with before step 4.
CENTRES = 6
#: Members beyond which a bucket goes to step 5 (one block); counters of step 5.
GIANT, COUNTERS = BLOCK_ROWS, 1 << 20
#: In place of a band key whose bucket is left out.
GONE = -(1 << 63)
REMEMBERED = 100_000
LOW = 0x5555555555555555
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


class _Words(dict):
    """word -> 64-bit hash; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of ``text``.

    A-Z are lower-cased; words are runs of other than 0x20 and 0x09-0x0D.  Fewer
    than k words make one shingle, none an empty set.
    """
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    size = min(k, n)
    with np.errstate(over="ignore"):
        s = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            s = (s ^ (s >> np.uint64(29))) * _M[0] + h[i : n - size + 1 + i]
        s = (s ^ (s >> np.uint64(32))) * _M[1]
        s ^= s >> np.uint64(29)
    return np.unique(s)


@cache
def _constants(perms: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**32, perms, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, perms, dtype=np.uint32)


def minima(shingles: np.ndarray, perms: int = PERMS) -> np.ndarray:
    a, b = _constants(perms)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(perms, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i : i + 2048, None] * a + b).min(axis=0))
    return low


def pack(low: np.ndarray) -> list[int]:
    two = (low & np.uint32(3)).astype(np.uint64).reshape(LONGS, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(two, axis=1).view(np.int64).tolist()


def band_keys(low: np.ndarray) -> list[int]:
    raw = low[: ROWS * BANDS].tobytes()
    step = 4 * ROWS
    return [xxhash.xxh3_64_intdigest(raw[i : i + step], seed=i + 1) - (1 << 63) for i in range(0, step * BANDS, step)]


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes()) + len(shingles).to_bytes(4, "big")


SIGS = "doc_id long, k1 long, k2 long, n long, set_key binary, bands array<long>, sig array<long>"


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2 (the row's key), n (size of the set), set_key, bands, sig
    (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        names = [f.split()[0] for f in SIGS.split(", ")]
        for b in text_slices(batches, 3):
            n, keys, bands, sigs = [], [], [], []
            for text in b.column(3).to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                keys.append(set_key(s))
                low = minima(s) if len(s) else None
                bands.append(None if low is None else band_keys(low))
                sigs.append(None if low is None else pack(low))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sigs, longs)], names)
        _words.clear()  # a worker outlives its task

    return _keyed(docs, id_col, text_col).mapInArrow(run, SIGS)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc_id.alias("doc_id"), *row_key(doc_id, text), text.alias("text"))


# estimates ------------------------------------------------------------------


def least_matches(percent: int) -> int:
    """Equal positions below which two signatures cannot reach ``percent``.

    With similarity J a position agrees with probability C + (1 - C) J, where
    C = 2**-BITS is the chance of equal low bits of different minima.
    """
    c = 2.0**-BITS
    p = c + (1 - c) * percent / 100
    return int(np.floor(PERMS * p - SLACK * np.sqrt(PERMS * p * (1 - p))))


def estimate(matches: float) -> float:
    """The corrected similarity."""
    c = 2.0**-BITS
    return (matches / PERMS - c) / (1 - c)


def matching(a: Column, b: Column) -> Column:
    """Positions at which two packed signatures agree."""
    differ = []
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        differ.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW))))
    return F.lit(PERMS) - reduce(lambda p, q: p + q, differ)


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As :func:`matching`, of every row of ``a`` with every row of ``b``."""
    out = np.full((len(a), len(b)), PERMS, np.int16)
    for i in range(LONGS):
        x = a[:, i, None] ^ b[None, :, i]
        out -= np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(LOW)).astype(np.int16)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, on the full sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


# steps ----------------------------------------------------------------------


def _buckets(reps: DataFrame, n_sets: int) -> DataFrame:
    """bkey, rep, n, centre for the members of buckets of two or more."""
    rows = reps.select(F.explode("bands").alias("bkey"), "rep", "n")
    shared = rows.groupBy("bkey").agg(F.min("rep").alias("centre"), F.count("*").alias("n_rows")).where("n_rows > 1")
    shared = materialize(shared, "minhash-shared", most_rows=BANDS * n_sets // 2)
    return join_hot(rows, shared, ["bkey"], BANDS * n_sets).drop("n_rows")


def _star_links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (centre, rep) that are links.  A centre's members (at most
    n_rows) are dealt out in chunks, so its text is repeated once for about CHUNK
    of them."""
    parts = F.ceil(F.col("n_rows") / CHUNK)
    members = pairs.select("centre", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), "rep")
    centres = members.select("centre", "part").distinct().withColumn("rep", F.col("centre"))
    rows = members.union(centres).join(texts, "rep").select("centre", "part", "rep", "set_key", "text")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("rep") != F.col("centre"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in text_slices(batches, 4):
            out: list[tuple[int, int]] = []
            for centre, part, rep, _, text in zip(*(c.to_pylist() for c in b.columns)):
                s = shingle_set(text, k)
                if rep == centre:
                    now, own = (centre, part), s
                elif now == (centre, part) and linked(own, s, percent):
                    out.append((centre, rep))
            yield _edges(out)

    return rows.mapInArrow(run, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _more_stars(members: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of the members of buckets larger than a block with CENTRES
    members of the bucket, where the components differ.  Linear in the members."""
    large = members.where(F.col("n_rows") > BLOCK_ROWS).groupBy("rep").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.collect_list(F.struct("bkey", "n_rows")).alias("in"))
    large = large.join(reps.select("rep", "sig"), "rep").select(F.inline("in"), "rep", "label", "n", "sig")
    large = materialize(large, "minhash-large", most_rows=members.count())
    member = F.struct("rep", "label", "n", "sig")
    picked = large.groupBy("bkey").agg(F.first("n_rows").alias("n_rows"), *(F.min_by(member, F.xxhash64("rep", F.lit(i))).alias(f"c{i}") for i in range(CENTRES)))
    picked = picked.withColumn("c", F.array_distinct(F.array(*(f"c{i}" for i in range(CENTRES))))).select("bkey", "n_rows", "c")
    n_large = large.count()
    met = join_hot(large.drop("n_rows"), materialize(picked, "minhash-picked", most_rows=n_large // BLOCK_ROWS), ["bkey"], n_large).select("rep", "label", "n", "sig", F.explode("c").alias("c"))
    near = (F.col("label") != F.col("c.label")) & (matching(F.col("sig"), F.col("c.sig")) >= least_matches(percent)) & (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
    pairs = materialize(met.where(near).select(F.col("c.rep").alias("centre"), "rep").distinct(), "minhash-pairs", most_rows=CENTRES * n_large)
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("n_rows"))
    n_pairs = pairs.count()
    return _star_links(join_hot(pairs, materialize(sizes, "minhash-centres", most_rows=n_pairs), ["centre"], n_pairs), texts, k, percent)


def _in_blocks(members: DataFrame) -> DataFrame:
    """Deal the members of each bucket into blocks and every pair of blocks to
    a task; adds lo, hi (the blocks) and own (the member's block).

    Where that takes fewer rows, the members of the bucket's largest component have
    blocks of their own, which meet only the blocks of the others: a component
    has no links to look for in itself.
    """
    blocks = lambda m: F.ceil(F.col(m) / BLOCK_ROWS).cast("int")
    of_label = members.groupBy("bkey", "label").agg(F.count("*").alias("m"))
    size = of_label.groupBy("bkey").agg(F.sum("m").alias("n_rows"), F.max(F.struct("m", "label")).alias("main"))
    size = size.select("bkey", "n_rows", F.col("main.label").alias("main"), F.col("main.m").alias("m1"), (F.col("n_rows") - F.col("main.m")).alias("m2")).where("m2 > 0")
    size = size.select("*", blocks("n_rows").alias("parts"), blocks("m1").alias("p1"), blocks("m2").alias("p2"))
    size = size.withColumn("split", F.expr("m1 * p2 + m2 * (p1 + p2) < n_rows * parts")).drop("m1", "m2")
    total = members.count()
    dealt = join_hot(members, materialize(size, "minhash-sizes", most_rows=total), ["bkey"], total)
    at, is_main = F.xxhash64("rep", F.lit(7)), F.col("split") & (F.col("label") == F.col("main"))
    own = F.when(is_main, F.col("p2") + F.pmod(at, F.col("p1"))).when(F.col("split"), F.pmod(at, F.col("p2"))).otherwise(F.pmod(at, F.col("parts"))).cast("int")
    meets = F.when(is_main, F.col("p2")).when(F.col("split"), F.col("p1") + F.col("p2")).otherwise(F.col("parts"))
    dealt = dealt.select(*members.columns, own.alias("own"), F.explode(F.sequence(F.lit(0), meets - 1)).alias("other"))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows with equal first ``keys`` columns."""
    group: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if group and row[:keys] != group[0][:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _open_pairs(own: np.ndarray, lo: int, hi: int, n: np.ndarray, sig: np.ndarray, bands: np.ndarray, label: np.ndarray, bkey: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one task that may be links and that this bucket is to judge."""
    least = least_matches(percent)
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    for s in range(0, len(left), 256):
        rows = left[s : s + 256]
        ok = _matches(sig[rows], sig[right]) >= least
        ok &= label[rows][:, None] != label[right][None, :]
        if lo == hi:
            ok &= rows[:, None] < right[None, :]
        small, large = np.minimum(n[rows][:, None], n[right][None, :]), np.maximum(n[rows][:, None], n[right][None, :])
        ok &= 100 * small >= percent * large
        i, j = np.nonzero(ok)
        for t in range(0, len(i), 50_000):
            x, y = rows[i[t : t + 50_000]], right[j[t : t + 50_000]]
            same = (bands[x] == bands[y]) & (bands[x] != GONE)
            first = bands[x, same.argmax(axis=1)] == bkey
            yield x[first], y[first]


def _unpacked(group: list[tuple], at: int):
    own, rep, n, label = (np.array([g[at + i] for g in group], np.int64) for i in range(4))
    sig = np.array([g[at + 4] for g in group], np.int64).view(np.uint64)
    bands = np.array([g[at + 5] for g in group], np.int64)
    return own, rep, n, label, sig, bands


TASK = ["bkey", "lo", "hi", "own", "rep", "n", "label", "sig", "bands"]


def _undecided(members: DataFrame, percent: int) -> DataFrame:
    """Members (bkey, rep) with a possible link to another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, 3):
            bkey, lo, hi = g[0][:3]
            own, rep, n, label, sig, bands = _unpacked(g, 3)
            hit = np.zeros(len(g), bool)
            for x, y in _open_pairs(own, lo, hi, n, sig, bands, label, bkey, percent):
                hit[x] = hit[y] = True
            found = rep[hit]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bkey)), pa.array(found)], ["bkey", "rep"])

    tasks = _in_blocks(members).select(*TASK).repartition("bkey", "lo", "hi").sortWithinPartitions("bkey", "lo", "hi")
    return tasks.mapInArrow(run, "bkey long, rep long").distinct()


def _block_links(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components, as many as join them within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, 3):
            bkey, lo, hi = g[0][:3]
            sets = [shingle_set(row[9], k) for row in g]
            own, rep, n, label, sig, bands = _unpacked(g, 3)
            root = {c: c for c in label.tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            out = []
            for x, y in _open_pairs(own, lo, hi, n, sig, bands, label, bkey, percent):
                for i, j in zip(x.tolist(), y.tolist()):
                    p, q = find(int(label[i])), find(int(label[j]))
                    if p != q and linked(sets[i], sets[j], percent):
                        root[max(p, q)] = min(p, q)
                        out.append((int(rep[i]), int(rep[j])))
            yield _edges(out)

    rows = _in_blocks(members).join(texts, "rep").select(*TASK, "text")
    return rows.repartition("bkey", "lo", "hi").sortWithinPartitions("bkey", "lo", "hi").mapInArrow(run, "a long, b long")


# step 5 ---------------------------------------------------------------------


def _counters(texts: DataFrame, k: int) -> np.ndarray:
    """How many of the sets hold shingles of each counter; COUNTERS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in text_slices(batches, 0):
            for text in b.column(0).to_pylist():
                np.add.at(total, (shingle_set(text, k) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for b in texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out


def _prefix_rows(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """bkey (a shingle), rep, n, label, sig, at (its place), index: the shingles that
    decide about links, rarest first.

    In one order of all shingles, sets of at least ``percent`` share one of their
    first n - ceil(percent n) + 1; the smaller of the two holds it among its first
    n - ceil(2 percent / (100 + percent) n) + 1, those with ``index``.  Any order
    is exact; counting makes what a template has in common come last.
    """
    held = texts.sparkSession.sparkContext.broadcast(_counters(texts, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 3):
            for rep, label, sig, text in zip(*(c.to_pylist() for c in b.columns)):
                s = shingle_set(text, k)
                n = len(s)
                first = n + percent * -n // 100 + 1
                own = n + 2 * percent * -n // (100 + percent) + 1
                order = np.lexsort((s, held.value[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:first]
                m = len(order)
                at = np.arange(m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[order].view(np.int64)), pa.array([rep] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array([label] * m, pa.int64()), pa.array([sig] * m, pa.list_(pa.int64())), pa.array(at), pa.array(at < own)],
                    ["bkey", "rep", "n", "label", "sig", "at", "index"],
                )

    return texts.select("rep", "label", "sig", "text").mapInArrow(run, "bkey long, rep long, n long, label long, sig array<long>, at long, index boolean")


def _prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that may be links, by place and estimate.

    A shingle of the template itself is in the prefixes of many sets.  Those that hold it
    too late for the smallest that it may be compared with are left out before the
    rest are dealt; what is left there is mostly one component (linked by its centre),
    which the blocks do not compare with itself.
    """
    least_n = F.min(F.when(F.col("index"), F.col("n")))
    live = rows.groupBy("bkey").agg(F.count("*").alias("n_rows"), least_n.alias("least_n"), F.min("label").alias("p"), F.max("label").alias("q")).where("n_rows > 1 and least_n is not null and p <> q").select("bkey", "n_rows", "least_n")
    total = rows.count()
    live = materialize(live, "minhash-rare", most_rows=total // 2)
    early = (F.col("n") - F.col("at")) * (100 + percent) >= percent * (F.col("n") + F.col("least_n"))
    kept = join_hot(rows.drop("sig"), live, ["bkey"], total).where(early).drop("n_rows", "least_n")
    kept = materialize(kept.join(rows.where("at = 0").select("rep", "sig"), "rep"), "minhash-prefixes", most_rows=total)
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, 3):
            own, rep, n, label, at = (np.array([x[i] for x in g], np.int64) for i in (3, 4, 5, 6, 8))
            index = np.array([x[9] for x in g], bool)
            sig = np.array([x[7] for x in g], np.int64).view(np.uint64)
            lo, hi = g[0][1:3]
            sides = [(lo, hi)] if lo == hi else [(lo, hi), (hi, lo)]
            for one, two in sides:
                left, right = np.flatnonzero((own == one) & index), np.flatnonzero(own == two)
                for t in range(0, len(left), 256):
                    x = left[t : t + 256]
                    a, b = x[:, None], right[None, :]
                    ok = (n[a] < n[b]) | ((n[a] == n[b]) & (rep[a] != rep[b]))
                    # what both can still share from here on
                    most = np.minimum(n[a] - at[a], n[b] - at[b])
                    ok &= most * (100 + percent) >= percent * (n[a] + n[b])
                    ok &= label[a] != label[b]
                    ok &= _matches(sig[x], sig[right]) >= least
                    i, j = np.nonzero(ok)
                    p, q = rep[x[i]], rep[right[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    tasks = _in_blocks(kept).select("bkey", "lo", "hi", "own", "rep", "n", "label", "sig", "at", "index").repartition("bkey", "lo", "hi").sortWithinPartitions("bkey", "lo", "hi")
    return tasks.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are links, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 2, 1 << 20):
            yield _edges([(p, q) for p, q, x, y in zip(*(c.to_pylist() for c in b.columns)) if linked(shingle_set(x, k), shingle_set(y, k), percent)])

    one, two = (texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


# the whole ------------------------------------------------------------------


def _decided(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc_id, k1, k2, set_key, n, component_id, first (whether
    its set is the one that stays of its component)."""
    sigs = materialize(signatures(docs, k, id_col, text_col), "minhash-signatures")
    able = sigs.where("n > 0 and doc_id is not null")
    of_set = F.min(F.struct("doc_id", "k1", "k2"))
    reps = able.groupBy("set_key").agg(of_set.alias("o"), F.count("*").alias("n_rows"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # numbered once, where it is written
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "set_key", "o.*", "n_rows", "n", "bands", "sig"), "minhash-sets", most_rows=sigs.count())
    n_sets = reps.count()
    buckets = materialize(_buckets(reps, n_sets), "minhash-buckets", most_rows=BANDS * n_sets)
    n_members = buckets.count()

    involved = reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("k1", "k2", "rep", "set_key")
    own = _keyed(docs, id_col, text_col).select("k1", "k2", "text").join(involved, ["k1", "k2"])
    texts = materialize(own.dropDuplicates(["k1", "k2", "rep"]).select("rep", "set_key", "text"), "minhash-texts")

    slim = reps.select("rep", "n", "sig")
    pairs = materialize(buckets.where("rep <> centre").select("rep", "centre").distinct(), "minhash-pairs", most_rows=n_members)
    centres = pairs.groupBy("centre").agg(F.count("*").alias("n_rows")).join(slim.select(F.col("rep").alias("centre"), F.col("n").alias("n2"), F.col("sig").alias("sig2")), "centre")
    pairs = join_hot(pairs.join(slim, "rep"), materialize(centres, "minhash-centres", most_rows=n_members), ["centre"], pairs.count())
    near = (matching(F.col("sig"), F.col("sig2")) >= least_matches(percent)) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    stars = materialize(_star_links(pairs.where(near).select("centre", "rep", "n_rows"), texts, k, percent), "minhash-stars")
    label = connected_components(stars, "minhash-components", stars.count())

    members = _mixed(buckets, label)
    if not members.where(F.col("n_rows") > BLOCK_ROWS).isEmpty():
        label = _joined(label, materialize(_more_stars(members, reps, texts, k, percent), "minhash-stars"))
        members = _mixed(members.drop("label", "n_rows", "n_all"), label)
    members = materialize(members.join(reps.select("rep", "sig", "bands"), "rep"), "minhash-mixed", most_rows=n_members)
    is_giant = (F.col("n_rows") > GIANT) | (F.col("n_all") > BLOCK_SHINGLES)
    giant = members.where(is_giant)
    has_giant = not giant.isEmpty()
    small = members.where(~is_giant).drop("n_rows", "n_all")
    if has_giant:
        # a pair is judged in its first shared band that is compared at all
        left_out = giant.groupBy("rep").agg(F.collect_set("bkey").alias("left_out"))
        compared = F.transform("bands", lambda x: F.when(F.array_contains("left_out", x), F.lit(GONE)).otherwise(x))
        small = materialize(small.join(left_out, "rep", "left").withColumn("bands", F.when(F.col("left_out").isNull(), F.col("bands")).otherwise(compared)).drop("left_out"), "minhash-small", most_rows=n_members)
    undecided = materialize(_undecided(small, percent), "minhash-undecided", most_rows=n_members)
    more = materialize(_block_links(small.join(undecided, ["bkey", "rep"], "left_semi"), texts, k, percent), "minhash-links")
    if not more.isEmpty():
        label = _joined(label, more)
    if has_giant:
        labelled = giant.select("rep").distinct().join(label, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("label", "rep").alias("label"))
        held = materialize(texts.join(labelled, "rep").join(slim.select("rep", "sig"), "rep"), "minhash-giant")
        rare = materialize(_prefix_pairs(materialize(_prefix_rows(held, k, percent), "minhash-rows"), percent), "minhash-candidates")
        more = materialize(_confirmed(rare, texts, k, percent), "minhash-links")
        label = _joined(label, more)

    labelled = reps.select("rep", "set_key", "n_rows", "doc_id").join(label, F.col("rep") == F.col("node"), "left").select("rep", "set_key", "n_rows", "doc_id", F.coalesce("label", "rep").alias("label"))
    labelled = materialize(labelled, "minhash-labelled", most_rows=n_sets)
    least = F.min(F.struct("doc_id", "rep"))
    component = materialize(labelled.groupBy("label").agg(least.alias("least"), F.count("*").alias("n_rows")), "minhash-least", most_rows=n_sets)
    joined = join_hot(labelled.withColumnRenamed("n_rows", "copies"), component, ["label"], n_sets)
    found = joined.select("set_key", F.col("copies").alias("n_rows"), F.col("least.doc_id").alias("component_id"), (F.col("least.rep") == F.col("rep")).alias("first"))
    joined = join_hot(able.select("doc_id", "k1", "k2", "set_key", "n"), materialize(found, "minhash-found", most_rows=n_sets), ["set_key"], sigs.count()).drop("n_rows")
    alone = sigs.where("n = 0 or doc_id is null").select("doc_id", "k1", "k2", "set_key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return joined.unionByName(alone)


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """``label`` after further links: those of before are known by the labels alone."""
    links = label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more.select("a", "b"))
    return connected_components(links, "minhash-components", links.count())


def _mixed(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets with several components: bkey, rep, n, label, n_rows and
    n_all (of the bucket).  Further links leave no bucket mixed that was not."""
    labelled = buckets.join(label, F.col("rep") == F.col("node"), "left").select("bkey", "rep", "n", F.coalesce("label", "rep").alias("label"))
    total = buckets.count()
    labelled = materialize(labelled, "minhash-members", most_rows=total)
    mixed = labelled.groupBy("bkey").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count("*").alias("n_rows"), F.sum("n").alias("n_all")).where("p <> q").drop("p", "q")
    return materialize(join_hot(labelled, materialize(mixed, "minhash-mixed", most_rows=total), ["bkey"], total), "minhash-members", most_rows=total)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have 100 * Jaccard >= percent.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest
    doc_id reachable), kept (doc_id = component_id).  Null or white text has no
    shingles and stands alone, with its own doc_id.  Rows without a doc_id take
    no part: component_id is null and they are kept.  Rows that repeat a doc_id
    are documents of their own and have one result each; those in the component
    of that doc_id are all kept, since an identifier cannot tell them apart.
    Empty table: empty result.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return _decided(docs, k, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component; columns unchanged.

    It is one of the smallest doc_id, and decided on rows: where a doc_id repeats,
    its other texts are judged by themselves, and of rows equal in doc_id and text
    one stays.  Rows without a doc_id or without words stand alone.
    """
    found = _decided(docs, k, percent, "doc_id", "text")
    kept = F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    decided = materialize(found.select("doc_id", "set_key", "k1", "k2", kept.alias("kept"), (F.col("doc_id").isNotNull() & (F.col("n") > 0)).alias("able")), "minhash-decided")
    n_rows = decided.count()
    # other texts with the identifier and the set of the one that stays
    ties = decided.where("kept and able").groupBy("doc_id", "set_key").agg(F.min(F.struct("k1", "k2")).alias("best"), F.max(F.struct("k1", "k2")).alias("worst")).where("best <> worst")
    ties = materialize(ties.select("doc_id", "set_key", "best"), "minhash-ties", most_rows=n_rows)
    again = decided.where("kept and able").join(ties, ["doc_id", "set_key"]).select("k1", "k2", (F.struct("k1", "k2") == F.col("best")).alias("stays"))
    rest = decided.where("not (kept and able)").union(decided.where("kept and able").join(ties, ["doc_id", "set_key"], "left_anti").select(*decided.columns))
    return keep_rows(docs, rest.select("k1", "k2", F.col("kept").alias("stays")).union(again), most_rows=n_rows)
