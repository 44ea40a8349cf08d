"""Hybrid retrieval: BM25, cosine, rank fusion, and what follows the ranking.

Many queries run at once.  The lexical leg joins query terms with an inverted
index, so its cost is that of the postings of the terms; the vector leg takes
the queries as a broadcast of checked size, compares blocks of vectors with
blocks of queries as matrices, and a task returns its best of each query only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import matching_form, tokens
from folioforge.operators import lexical
from folioforge.sources.scratch import written

K1, B, RRF = 1.2, 0.75, 60
FETCH_LEAST, KNN_MOST = 30, 1000
BOOST = 1.2
CUT_LEAST, CUT_SHARE = 10, 0.4
BUDGET = 16_000
#: Bytes of query vectors (and of the best that a task holds of them) that may be broadcast.
QUERY_BYTES = 64 << 20
#: Bytes of vectors in a block, and cells of a matrix of cosines that a worker holds.
BLOCK_BYTES, CELLS = 16 << 20, 4 << 20
#: Scores are rounded to six digits; what may round to a threshold is so near it.
NEAR = 2e-6


def inverted_index(docs: DataFrame, wanted: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """id, field (its number), n_words, term, tf: the postings of the ``wanted``
    terms, and for every field of every document one row without a term.

    One pass over the text.  Terms that no query has are dropped where they are
    read if the wanted ones are few enough to be sent there.
    """
    parts = [F.struct(F.lit(i).alias("field"), tokens(matching_form(F.col(f))).alias("w")) for i, f in enumerate(fields)]
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("x"))
    rows = words.select("id", "x.field", F.size("x.w").alias("n_words"), F.explode(F.concat("x.w", F.array(F.lit(None).cast("string")))).alias("term"))
    size = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    if size <= QUERY_BYTES:
        rows = rows.join(F.broadcast(wanted.select("term", F.lit(True).alias("__is"))), "term", "left").where("term is null or __is")
        return rows.groupBy("id", "field", "n_words", "term").agg(F.count("*").alias("tf"))
    counted = rows.groupBy("id", "field", "n_words", "term").agg(F.count("*").alias("tf"))
    return counted.where("term is null").unionByName(counted.join(wanted, "term", "left_semi"))


def bm25(queries: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str | Sequence[str] = "text", within: str | None = None) -> DataFrame:
    """query_id, id, score for every document with a query term; for the best of
    them there is :func:`folioforge.operators.lexical.search`.

    ``queries``: query_id, query.  ``text``: one field or several; each has
    statistics of its own and the scores add up.  Counts and mean lengths cover
    all documents.  ``within``: a column of both sides (the analysis, say) in
    which query and document must agree.
    """
    fields = [text] if isinstance(text, str) else list(text)
    wanted = queries.select("query_id", *([within] if within else []), F.explode(F.array_distinct(tokens(matching_form(F.col("query"))))).alias("term"))
    index = written(inverted_index(docs, wanted.select("term").distinct(), id_col, fields), "bm25-index")
    hits = index.where("term is not null")
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    stats = index.where("term is null").groupBy("field").agg(F.sum("tf").alias("n"), (F.sum(F.col("n_words") * F.col("tf")) / F.sum("tf")).alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.col("mean")))
    # stats has one row per field
    weighted = hits.join(df, ["field", "term"]).join(F.broadcast(stats), "field").select("term", "id", weight.alias("w"))
    if within:
        weighted = weighted.join(docs.select(F.col(id_col).alias("id"), within), "id")
        return weighted.join(wanted, ["term", within]).groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return weighted.join(wanted, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def knn_size(top_k: int) -> int:
    return min(max(3 * top_k, FETCH_LEAST), KNN_MOST)


def knn(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, id, score (cosine), rank: the k nearest of each query.

    ``queries``: query_id, query_vec; a stated set, broadcast in parts of at most
    QUERY_BYTES, one pass over the vectors each.  A task returns at most k rows
    per query.  Every pair is compared, so the work grows with their product.
    Vectors that are null or zero, or have a null in them, score 0; those of
    another length than the query have no score and come last.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"))
    n_asked, cells = asked.agg(F.count("*"), F.sum(F.when(F.col("query_vec").isNotNull(), F.size("query_vec")))).first()
    n, out = max(1, -(-(8 * (cells or 0) + 48 * k * n_asked) // QUERY_BYTES)), None
    held = vectors.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    # a file's row groups may be few and large, and the work is that of all queries for each vector
    held = held.repartition(2 * spark.sparkContext.defaultParallelism)
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema, *held.schema]}
    for i in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        rows = part.toArrow()  # of checked size
        sent = spark.sparkContext.broadcast((rows["query_id"].combine_chunks(), _by_length(rows["query_vec"].combine_chunks())))
        found = top(held.mapInArrow(_nearest(sent, k), f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), k)
        if n > 1:  # the next part takes this one's place in memory
            found = written(found, "knn-part")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _by_length(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(whether a vector has a direction, and for each length the vectors that have
    one: their places, a matrix of them, their norms)."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    ends = np.cumsum(lens)
    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = gaps[ends] == gaps[ends - lens]
    flat = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    turned, out = np.zeros(len(column), bool), []
    for n in np.unique(lens[lens > 0]).tolist():
        at = np.flatnonzero((lens == n) & whole)
        m = flat[(ends - lens)[at][:, None] + np.arange(n)]
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        some = ~(norm <= 0)
        turned[at[some]] = True
        out.append((at[some], m[some], norm[some]))
    return turned, out


def _nearest(sent: object, k: int):
    """Of a task's vectors the k best (score, then id) of every query sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (turned, groups) = sent.value
        flat = np.flatnonzero(~turned)
        best: list[list[tuple]] = [[] for _ in range(len(asked))]
        theta = np.full(len(asked), -np.inf)  # the k-th score of a query so far
        id_type = None

        def meet(places: np.ndarray, scores: np.ndarray, ids: list) -> None:
            may = scores >= (theta[places] - NEAR)[:, None]
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                at = np.flatnonzero(may[i])
                s = scores[i, at]
                if len(at) > 2 * k:
                    near = s >= np.partition(s, -k)[-k] - NEAR
                    at, s = at[near], s[near]
                s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5) / 1e6, s) + 0.0  # halves go up, as in SQL
                if len(at) > k:  # the block is sorted by id
                    first = np.argsort(-s, kind="stable")[:k]
                    at, s = at[first], s[first]
                own = best[places[i]] + [(-x, ids[j]) for x, j in zip(s.tolist(), at.tolist())]
                own.sort(key=lambda x: (x[0], x[1] is not None, x[1]))
                best[places[i]] = own[:k]
                if len(own) >= k:
                    theta[places[i]] = -own[k - 1][0]

        for b in batches:
            id_type = b.column(0).type
            size = max(1, pc.sum(pc.list_value_length(b.column(1))).as_py() or 1) * 8
            step = max(1, min(b.num_rows * BLOCK_BYTES // size, CELLS))
            for start in range(0, b.num_rows, step):
                block = b.slice(start, step)
                block = block.take(pc.sort_indices(block.column(0), null_placement="at_start"))
                ids, (has, vectors) = block.column(0).to_pylist(), _by_length(block.column(1))
                wide = max(1, CELLS // len(ids))
                for lo in range(0, len(flat), wide):
                    meet(flat[lo : lo + wide], np.zeros((len(flat[lo : lo + wide]), len(ids))), ids)
                for places, q, norm in groups:
                    of = [x for x in vectors if x[1].shape[1] == q.shape[1]]
                    for lo in range(0, len(places), wide):
                        scores = np.tile(np.where(has, -np.inf, 0.0), (len(places[lo : lo + wide]), 1))
                        for at, m, own in of:
                            cos = (q[lo : lo + wide] @ m.T) / (norm[lo : lo + wide, None] * own)
                            scores[:, at] = np.where(np.isnan(cos), np.inf, cos)  # NaN is the largest in SQL
                        meet(places[lo : lo + wide], scores, ids)
        for lo in range(0, len(asked), 1000):
            rows = [(lo + i, x[1], -x[0]) for i, own in enumerate(best[lo : lo + 1000]) for x in own]
            if rows:
                at, ids, scores = zip(*rows)
                scores = [None if x == -np.inf else np.nan if x == np.inf else x + 0.0 for x in scores]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(at)), pa.array(ids, id_type), pa.array(scores, pa.float64())], ["query_id", "id", "score"])

    return run


def top(scored: DataFrame, k: int) -> DataFrame:
    """Adds rank (1 = best; ties by id) and keeps the first k of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(*legs: DataFrame, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank) -> score."""
    parts = legs[0].select("query_id", "id", "rank")
    for x in legs[1:]:
        parts = parts.unionByName(x.select("query_id", "id", "rank"))
    return parts.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))


def token_overlap(query: Column, content: Column) -> Column:
    """Different query words of more than two letters that the text has."""
    q = F.filter(F.array_distinct(tokens(matching_form(query))), lambda t: F.char_length(t) > 2)
    return F.size(F.array_intersect(q, tokens(matching_form(content))))


def rank_with_overlap(hits: DataFrame) -> DataFrame:
    """hits: query_id, id, score, overlap -> rank by score, overlap, id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("overlap"), "id")
    return hits.withColumn("rank", F.row_number().over(w))


def hybrid(queries: DataFrame, chunks: DataFrame, top_k: int = 25, fields: Sequence[str] = ("content",), within: str | None = None, index: lexical.LexicalIndex | None = None) -> DataFrame:
    """query_id, id, score, overlap, rank.

    ``queries``: query_id, query, query_vec (may be null: lexical only).
    ``chunks``: id, content, embedding.  Without any hit and without a vector the
    first chunks by id are returned with score 0.  ``fields`` are searched
    lexically; ``within`` is a column of both (the analysis) that must agree.
    ``index``: of the chunks by id over these fields, if it is stored already.
    """
    fetch = max(2 * top_k, FETCH_LEAST)
    index = index or lexical.build(chunks, None, "id", fields, within, queries=queries)
    by_words = lexical.search(index, queries, fetch, within)
    asked = queries.where("query_vec is not null")
    if within:
        pairs = chunks.select(within, "id", "embedding").join(asked.select(within, "query_id", "query_vec"), within)
        vector = top(pairs.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("query_vec")), 6).alias("score")), knn_size(top_k))
    else:
        vector = knn(asked, chunks, knn_size(top_k), "id", "embedding")
    both = top(fuse(by_words, vector), fetch)
    with_text = both.join(chunks.select("id", "content"), "id").join(queries.select("query_id", "query"), "query_id")
    ranked = rank_with_overlap(with_text.select("query_id", "id", "score", token_overlap(F.col("query"), F.col("content")).alias("overlap")))
    without = queries.where("query_vec is null").join(both, "query_id", "left_anti")
    if within:
        first = top(chunks.select(F.col(within).alias("query_id"), "id", F.lit(0.0).alias("score")), fetch).select(F.col("query_id").alias(within), "id", "rank")
        wild = without.select(within, "query_id").join(first, within)
    else:
        first = chunks.select("id").orderBy("id").limit(fetch).withColumn("rank", F.row_number().over(Window.orderBy("id")))
        wild = without.select("query_id").crossJoin(F.broadcast(first))
    wild = wild.select("query_id", "id", F.lit(0.0).alias("score"), F.lit(0).alias("overlap"), "rank")
    return ranked.unionByName(wild)


def expand_parents(hits: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """Children give way to their parents inside the window of 2 * top_k.

    ``hits``: query_id, id, score, rank.  ``chunks``: id, parent_id.  A parent
    comes once, at the rank and with the score of its first child (matched_id);
    a child whose parent is unknown stays itself.
    """
    window = hits.where(F.col("rank") <= 2 * top_k).join(chunks.select("id", "parent_id"), "id", "left")
    known = chunks.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    at = window.join(known, "parent_id", "left").withColumn("matched_id", F.col("id")).withColumn("id", F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("id")))
    best = at.groupBy("query_id", "id").agg(F.min_by(F.struct("score", "matched_id", "rank"), "rank").alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.rank")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "id", "b.score", "b.matched_id", "rank")


def boost_category(hits: DataFrame, category: str | Column, top_k: int | Column, factor: float = BOOST) -> DataFrame:
    """Raises chunks of a category (or of each row's own); a missing score is 1 / (rank + 1), rank from 0.

    ``hits``: query_id, id, rank (from 1), score, primary_category,
    secondary_categories.
    """
    base = F.coalesce("score", 1.0 / F.col("rank"))
    fits = F.coalesce(F.col("primary_category") == category, F.lit(False)) | F.coalesce(F.array_contains("secondary_categories", category), F.lit(False))
    out = hits.withColumn("boosted", F.round(base * F.when(fits, factor).otherwise(1.0), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "rank")
    return out.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_k)


def relevance_cut(hits: DataFrame, least: int = CUT_LEAST, share: float = CUT_SHARE) -> DataFrame:
    """Keeps the ``least`` best, rows without a score, and those at ``share`` of
    the best score or more; up to ``least`` rows all stay."""
    q = Window.partitionBy("query_id")
    best = q.orderBy(F.col("score").desc_nulls_last(), "rank")
    out = hits.withColumn("__n", F.count("*").over(q)).withColumn("__top", F.max("score").over(q)).withColumn("__at", F.row_number().over(best))
    keep = (F.col("__n") <= least) | (F.col("__at") <= least) | F.col("score").isNull() | (F.col("score") >= share * F.col("__top"))
    return out.where(keep).drop("__n", "__top", "__at")


def token_budget(hits: DataFrame, budget: int = BUDGET, size: str = "token_count") -> DataFrame:
    """The longest prefix by rank within the budget; the first row always."""
    w = Window.partitionBy("query_id").orderBy("rank")
    out = hits.withColumn("__sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__at", F.row_number().over(w))
    return out.where((F.col("__at") == 1) | (F.col("__sum") <= budget)).drop("__sum", "__at")


def purity(hits: DataFrame, category: str) -> DataFrame:
    """query_id, n, n_target, purity (the share of one category)."""
    target = F.count_if(F.col("primary_category").eqNullSafe(category))
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), target.alias("n_target"), F.round(target / F.count("*"), 6).alias("purity"))


def category_distribution(hits: DataFrame) -> DataFrame:
    """query_id, primary_category (null: none), n, share of the query's hits."""
    n = hits.groupBy("query_id", "primary_category").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("query_id")), 6))


def prompt_fragment(no: Column, label: Column, page: Column, section: Column, kind: Column, content: Column) -> Column:
    return F.format_string("[%d] %s, p. %d, %s (%s)\n%s", no, F.coalesce(label, F.lit("?")), page, F.coalesce(section, F.lit("general")), kind, content)
