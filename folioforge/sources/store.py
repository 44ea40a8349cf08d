"""Reading and writing the entity tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas

CAP = 50_000


def chunks_of(index: DataFrame, analysis_id: str, cap: int | None = None) -> tuple[DataFrame, bool]:
    """All chunks of an analysis in order, and whether a cap (CAP, say) cut some off."""
    rows = index.where(F.col("analysis_id") == analysis_id)
    if cap is None:
        return rows.orderBy("document_id", "chunk_index"), False
    cut = rows.select("id").limit(cap + 1).count() > cap
    return rows.orderBy("document_id", "chunk_index").limit(cap), cut


def documents_of(documents: DataFrame, analysis_id: str, include_deleted: bool = False) -> DataFrame:
    rows = documents.where(F.col("analysis_id") == analysis_id)
    rows = rows if include_deleted else rows.where(~F.coalesce("deleted", F.lit(False)))
    return rows.orderBy("uploaded_at", "document_id")


def project(df: DataFrame, schema: StructType) -> tuple[DataFrame, list[str]]:
    """Only declared columns, and the names of those that were dropped."""
    names = set(schema.names)
    return df.select(*[c for c in df.columns if c in names]), [c for c in df.columns if c not in names]


def check_contract(df: DataFrame, required: Sequence[str], dim: int | None = None, vector: str = "embedding") -> None:
    """Refuses an index without the required columns or with vectors of another size."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if dim is not None and not df.where(F.col(vector).isNull() | (F.size(vector) != dim)).isEmpty():
        raise ValueError(f"vectors that do not have {dim} numbers")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Index rows as chunks: what is absent has its default."""
    table_ref = F.from_json("table_ref", schemas.TABLE_REF)
    blocks = F.from_json("blocks", f"array<{schemas.SOURCE_BLOCK}>")
    kinds = dict(rows.dtypes)
    out = rows.withColumns(
        {
            "section_path": F.coalesce("section_path", F.lit("general")),
            "block_type": F.coalesce("block_type", F.lit("paragraph")),
            "chunk_type": F.coalesce("chunk_type", F.lit("normal")),
        }
    )
    if kinds.get("table_ref") == "string":  # JSON that cannot be read is null
        out = out.withColumn("table_ref", table_ref)
    return out.withColumn("blocks", blocks) if kinds.get("blocks") == "string" else out


def index_ids(chunks: DataFrame, analysis_id: str) -> DataFrame:
    """Adds id and the ids of parent and children; needs chunk_index, parent_chunk_index."""
    name = lambda c: F.concat_ws("--", F.lit(analysis_id), "document_id", c.cast("string"))
    out = chunks.withColumn("analysis_id", F.lit(analysis_id)).withColumn("id", name(F.col("chunk_index")))
    return out.withColumn("parent_chunk_id", F.when(F.col("parent_chunk_index").isNotNull(), name(F.col("parent_chunk_index"))))


def write_index(chunks: DataFrame, path: str) -> None:
    """Replaces the partitions of the analyses in ``chunks``; others stay.

    An analysis without chunks is not touched: use :func:`delete_index` for it.
    """
    check_contract(chunks, ["analysis_id", "id", "embedding"])
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def delete_index(spark: SparkSession, path: str, analysis_id: str) -> int:
    """Removes the partition of an analysis; returns the rows that it had."""
    from pyspark.errors import AnalysisException

    try:
        n = spark.read.parquet(path).where(F.col("analysis_id") == analysis_id).count()
    except AnalysisException:
        return 0
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/analysis_id={analysis_id}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return n


def write_all(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """One batch into several sinks (the body of a foreachBatch); failures by name.

    The batch is computed once.  All sinks are tried; one that fails does not
    keep the others from their rows.
    """
    held = batch.persist()
    failed = {}
    try:
        for name, put in sinks.items():
            try:
                put(held)
            except Exception as e:  # noqa: BLE001  reported to the caller
                failed[name] = f"{type(e).__name__}: {e}"
    finally:
        held.unpersist()
    return failed
