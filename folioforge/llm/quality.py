"""Quality classifier: ordinal regression with cumulative links.

Ratings are graded (0 < 1 < ...).  One weight vector over hashed features of the
text is shared by all grades, and ordered thresholds cut the line:
P(grade <= k) = sigmoid(threshold[k] - w.x).  From it follow the expected grade
and the probability of the top grade, on which selection rests.

The model is fitted on at most ``SAMPLE`` rated documents, chosen by a hash of
their identifiers; every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, text_slices

#: Rated documents that the fit uses at most.
SAMPLE = 8000
SLOTS = 1 << 18
#: A slot counts if at least so many of the sampled documents have it.
LEAST_DOCS = 3
CHI2 = 40.0
EPOCHS, RATE, RIDGE = 150, 0.05, 0.3
REMEMBERED = 100_000
CHARACTER = re.compile(f"[{UNSPACED}]")
EDGE = re.compile(r"^\W+|\W+$")


class _Slots(dict):
    """word -> its slots; forgets everything when it has grown too large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        core = EDGE.sub("", word)
        marks = word[len(word.rstrip(",.;:!?*%&$#@|\"')(")) :].strip(",.")
        names = ["w" + core.lower(), "p" + core[:4].lower()]
        if marks:
            names.append("m" + marks[:3])
        if len(core) > 2 and core.isupper():
            names.append("upper")
        out = self[word] = tuple(xxhash.xxh32_intdigest(n) % SLOTS for n in names)
        return out


_slots = _Slots()


def _level(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def features(text: str | None) -> np.ndarray:
    """Ascending slots of the features that the text has (each counts once)."""
    words = (text or "").split()
    if text and not text.isascii() and CHARACTER.search(text):
        # without spaces the characters are the words
        words = CHARACTER.sub(r" \g<0> ", text).split()
    kinds = set(words)
    out = {s for w in kinds for s in _slots[w]}
    n = len(words)
    if n:
        odd = sum(map(text.count, "*%&$#|!~^<>{}")) / n
        lines = [x for x in text.split("\n") if x.strip()]
        shape = (
            ("odd", _level(odd, (0.02, 0.1, 0.3, 0.8))),
            ("big", _level(sum(map(str.isupper, words)) / n, (0.05, 0.15, 0.4, 0.8))),
            ("kinds", _level(len(kinds) / n, (0.2, 0.4, 0.6, 0.8))),
            ("lines", _level(len(set(lines)) / max(1, len(lines)), (0.3, 0.6, 0.9))),
            ("digits", _level(sum(map(str.isdigit, words)) / n, (0.02, 0.1, 0.3))),
            ("size", _level(n, (5, 20, 80, 400))),
        )
        out.update(xxhash.xxh32_intdigest(f"={k}{v}") % SLOTS for k, v in shape)
    return np.fromiter(sorted(out), dtype=np.int32, count=len(out))


@dataclass(frozen=True)
class Ordinal:
    """Shared weights and ascending thresholds; grades 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[x].sum(), -60, 60)))


def _telling(flat: np.ndarray, doc: np.ndarray, seen: np.ndarray, grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Slots whose documents are graded unlike the rest: the count below some
    cut is at least CHI2 (chi-square of the two-by-two table) off."""
    out = np.zeros(SLOTS, bool)
    n = len(grades)
    for k in range(1, n_grades):
        low = (grades < k).astype(float)
        total = low.sum()
        got = np.bincount(flat, weights=low[doc], minlength=SLOTS)
        expected = seen * total / n
        spread = expected * (1 - total / n) * np.maximum(1 - seen / n, 1e-9)
        out |= (got - expected) ** 2 >= CHI2 * np.maximum(spread, 1e-9)
    return out & (seen > 0)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> Ordinal:
    """Maximum likelihood with a ridge penalty, by Adam over the whole sample.

    Without rows, or with one grade only, every document gets the top grade.
    """
    if not len(rows) or len(set(grades.tolist())) < 2:
        return Ordinal(np.zeros(SLOTS), np.full(n_grades - 1, -30.0))
    flat = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=SLOTS)
    keep = (seen >= LEAST_DOCS) & (seen < len(rows)) & _telling(flat, doc, seen, grades, n_grades)
    number = np.cumsum(keep) - 1
    ok = keep[flat]
    flat, doc = number[flat[ok]], doc[ok]
    m, n = int(keep.sum()), len(rows)
    # thresholds: the first, then the logarithms of the steps
    share = np.clip(np.array([(grades < k).mean() for k in range(1, n_grades)]), 1e-3, 1 - 1e-3)
    base = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    par = np.concatenate([np.zeros(m), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    one, two = np.zeros_like(par), np.zeros_like(par)
    at = np.arange(n)
    for step in range(1, epochs + 1):
        cuts = par[m] + np.concatenate([[0.0], np.cumsum(np.exp(par[m + 1 :]))])
        score = np.bincount(doc, weights=par[:m][flat], minlength=n)
        z = np.hstack([np.full((n, 1), -40.0), cuts[None] - score[:, None], np.full((n, 1), 40.0)])
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = p * (1 - p)
        mass = np.maximum(p[at, grades + 1] - p[at, grades], 1e-9)
        up, down = slope[at, grades + 1] / mass, slope[at, grades] / mass
        g_score = up - down  # of the negative logarithm, by the score
        g_cut = np.array([(down[grades == k + 1].sum() - up[grades == k].sum()) for k in range(n_grades - 1)])
        g = np.empty_like(par)
        g[:m] = np.bincount(flat, weights=g_score[doc], minlength=m) + ridge * par[:m]
        g[m] = g_cut.sum()
        for k in range(1, n_grades - 1):
            g[m + k] = g_cut[k:].sum() * np.exp(par[m + k])
        one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
        par -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(SLOTS)
    weights[keep] = par[:m]
    return Ordinal(weights, par[m] + np.concatenate([[0.0], np.cumsum(np.exp(par[m + 1 :]))]))


N_GRADES = 3


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good; of several rows the least.

    Rows without a doc_id or without both ratings are no ratings; a missing one
    of the two counts as harmless (not toxic) or poor (no quality).
    """
    toxic, quality = F.coalesce("toxic", F.lit(0)), F.coalesce("quality", F.lit(0))
    rated = labels.where("doc_id is not null and (toxic is not null or quality is not null)")
    grade = F.when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)
    return rated.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` rated documents.

    The chosen identifiers are those with the least hash, so the join has a side
    of bounded size; features are made by the executors and only they are
    gathered.
    """
    chosen = graded(labels).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            slots = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(slots, pa.list_(pa.int32()))], ["doc_id", "grade", "slots"])
        _slots.clear()  # a worker outlives its task

    got = sorted(picked.mapInArrow(run, "doc_id long, grade int, slots array<int>").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["slots"]))
    return fit([np.array(r["slots"], np.int32) for r in got], np.array([r["grade"] for r in got], np.int64), N_GRADES)


def score(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_top (probability of the top grade), selected.

    Null or empty text has no features and gets the scores of the thresholds
    alone.  Rows are independent; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            above = [held.value.above(features(t)) for t in b.column(1).to_pylist()]
            expected, top = [round(float(a.sum()), 6) for a in above], [round(float(a[-1]), 6) for a in above]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected, pa.float64()), pa.array(top, pa.float64()), pa.array([t >= least for t in top], pa.bool_())], ["doc_id", "expected_grade", "p_top", "selected"])
        _slots.clear()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, expected_grade double, p_top double, selected boolean")


def select_good(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject; columns unchanged.
    Rows are judged where they are; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([round(float(held.value.above(features(t))[-1]), 6) >= least for t in texts], pa.bool_()))
        _slots.clear()

    return docs.mapInArrow(run, docs.schema)
