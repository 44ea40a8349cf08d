"""Ingesting again: what has changed between two states of an index, and an
embedding store that is addressed by content.

A chunk is told by its document and the digest of what is embedded of it; of equal
chunks of a document the n-th of one state is the n-th of the other.  A model is
asked only for digests that the store has not seen, whatever document they are
from, so ingesting an analysis again with one changed document embeds the new
chunks of that document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.contain import join_hot
from folioforge.operators.extract import embed
from folioforge.sources import store
from folioforge.sources.scratch import written


def content_digest(model: str = "") -> Column:
    """Of the model's name, title and content; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))), 256)


def difference(old: DataFrame, new: DataFrame, document: str = "document_id", order: str = "chunk_index", digest: str = "digest") -> DataFrame:
    """document, digest, occurrence, old_at, new_at, change: added, removed, moved (kept
    at another place of its document) or kept.

    Both sides: document, order, digest.  Repeated chunks are matched in order.  A
    null document is a document like others.
    """

    def side(df: DataFrame, at: str) -> DataFrame:
        w = Window.partitionBy(document, digest).orderBy(order)
        return df.select(F.col(document).alias("document"), F.col(digest).alias("digest"), (F.row_number().over(w) - 1).alias("occurrence"), F.col(order).alias(at))

    a, b = side(old, "old_at").alias("a"), side(new, "new_at").alias("b")
    same = F.col("a.document").eqNullSafe(F.col("b.document")) & F.col("a.digest").eqNullSafe(F.col("b.digest")) & (F.col("a.occurrence") == F.col("b.occurrence"))
    both = a.join(b, same, "full_outer")
    change = F.when(F.col("a.occurrence").isNull(), "added").when(F.col("b.occurrence").isNull(), "removed").when(F.col("old_at") != F.col("new_at"), "moved").otherwise("kept")
    have = lambda c: F.when(F.col("b.occurrence").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return both.select(have("document"), have("digest"), have("occurrence"), "old_at", "new_at", change.alias("change"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """digest, embedding: one row per digest; None where nothing is stored yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.schema("digest string, embedding array<float>").parquet(path)
    # a write that was repeated after a failure has stored some twice
    return rows.groupBy("digest").agg(F.first("embedding").alias("embedding"))


def embed_stored(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dim: int, path: str, model: str = "") -> tuple[DataFrame, int]:
    """(chunks with digest and embedding, number of texts that the model was asked for).

    New vectors are appended to the store at ``path`` before they are used, so a
    job that fails later does not ask for them again.  ``model`` keeps the
    vectors of different models apart.  Equal texts are asked for once.
    """
    spark = chunks.sparkSession
    named = written(chunks.withColumn("digest", content_digest(model)), "embed-chunks")
    texts = named.groupBy("digest").agg(F.first(F.struct("title", "content")).alias("t"), F.count("*").alias("n_rows"))
    have = stored(spark, path)
    missing = texts if have is None else texts.join(have.select("digest"), "digest", "left_anti")
    made = written(embed(missing.select("digest", "t.title", "t.content"), embedder, dim).select("digest", "embedding"), "embed-new")
    asked = made.count()
    if asked:
        made.write.mode("append").parquet(path)
    vectors = stored(spark, path)
    if vectors is None:
        return named.withColumn("embedding", F.lit(None).cast("array<float>")), 0
    side = vectors.join(texts.select("digest", "n_rows"), "digest")
    return join_hot(named.drop("embedding"), written(side, "embed-side"), ["digest"]), asked


def ingest_again(chunks: DataFrame, index_path: str, embedder: Callable[[list[str]], list[list[float]]], dim: int, store_path: str, model: str = "") -> tuple[DataFrame, int]:
    """Replace the analyses of ``chunks`` in the index; (difference, texts embedded).

    ``chunks``: rows of ``store.index_ids`` without embedding.  Stale chunks (of
    documents that have changed or gone) are no longer in the index; analyses
    that ``chunks`` has none of are not touched.
    """
    spark = chunks.sparkSession
    fresh, asked = embed_stored(chunks, embedder, dim, store_path, model)
    fresh = written(fresh, "ingest-fresh")
    name = F.concat_ws("\x1f", "analysis_id", "document_id")
    new = fresh.select(name.alias("document_id"), "chunk_index", "digest")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index_path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        before = spark.read.parquet(index_path).join(fresh.select("analysis_id").distinct(), "analysis_id", "left_semi")
        old = before.select(name.alias("document_id"), "chunk_index", "digest")
    else:
        old = new.limit(0)
    changes = written(difference(old, new), "ingest-changes")  # before the old rows are replaced
    store.write_index(fresh, index_path)
    return changes, asked
