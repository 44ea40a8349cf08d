"""Documents as binary files; what reads their layout is an exchangeable part."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .schemas import LAYOUT

WAITS = (1.0, 5.0, 15.0)


class Throttled(Exception):
    """The reader asks to come back later: the wait doubles."""


OUT = "document_id string, path string, content_hash string, markdown string, error string, page_count int, encrypted boolean, " + ", ".join(f"{n} {kind}" for n, kind in LAYOUT.items())


def read_layout(spark: SparkSession, path: str, reader: Callable[[bytes], str | dict], waits: tuple[float, ...] = WAITS) -> DataFrame:
    """A row for every file below ``path``: document_id, path, content_hash,
    markdown, error, page_count, encrypted, and the parts in ``LAYOUT``.

    ``reader`` turns a file into markdown, or into a dict with markdown and any of
    the other columns (absent ones are null); it is tried once more after each
    of ``waits`` but the last.  A text that stays empty is an error of that row,
    never of the job.
    """

    def attempt(data: bytes) -> dict:
        error = None
        for i, wait in enumerate(waits):
            try:
                made = reader(data)
                made = dict(made) if isinstance(made, dict) else {"markdown": made}
                if made.get("markdown") and made["markdown"].strip():
                    return made
                return made | {"markdown": None, "error": "empty text"}
            except Throttled as e:
                error, wait = f"throttled: {e}", 2 * wait
            except Exception as e:  # noqa: BLE001  becomes the row's error
                error = f"{type(e).__name__}: {e}"
            if i + 1 < len(waits):
                time.sleep(wait)
        return {"error": error}

    names = ["markdown", "error", "page_count", "encrypted", *LAYOUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                made = attempt(row.pop("content"))
                yield pa.RecordBatch.from_pylist([row | {n: made.get(n) for n in names}], schema)

    schema = to_arrow_schema(StructType.fromDDL(OUT))
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(F.left(F.sha2(F.col("path"), 256), F.lit(24)).alias("document_id"), "path", F.sha2("content", 256).alias("content_hash"), "content")
    return rows.mapInArrow(run, OUT)
