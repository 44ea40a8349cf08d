"""Table functions for Spark SQL, to be called laterally or over a partitioned table.

    register(spark)
    SELECT doc_id, w.* FROM docs, LATERAL text_windows(text, 700, 120) w
    SELECT id, c.* FROM sections, LATERAL clauses(content) c
    SELECT * FROM section_walk(TABLE(blocks))

``section_walk`` states itself that it wants the blocks of a document together and
in reading order.  Each gives what the DataFrame form gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from folioforge.operators import chunking, sections



def _struct(**fields: DataType) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


# analysis runs in a worker, which cannot parse DDL
_INT, _TEXT = IntegerType(), StringType()
_PARA = _struct(page=_INT, idx=_INT)
_BOX = _struct(page=_INT, x=DoubleType(), y=DoubleType(), width=DoubleType(), height=DoubleType())
_TABLE = _struct(table_id=_TEXT, row_index=_INT, headers=ArrayType(_TEXT))
#: schemas.SECTION
_SECTION = _struct(
    document_id=_TEXT, block_no=_INT, page_number=_INT, block_type=_TEXT, content=_TEXT, heading_path=ArrayType(_TEXT), is_heading=BooleanType(), table_ref=_TABLE,
    table_context=_TEXT, blocks=ArrayType(_struct(para_id=_PARA, bbox=ArrayType(_BOX), content=_TEXT)),
)

#: White space of :func:`folioforge.functions.text.tokens`.
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _text(argument: AnalyzeArgument, name: str) -> None:
    if argument.isTable or not isinstance(argument.dataType, StringType):
        raise ValueError(f"{name} takes a text")


def _number(argument: AnalyzeArgument | None, otherwise: int, name: str) -> int:
    if argument is None:
        return otherwise
    if not argument.isConstantExpression or not isinstance(argument.value, int) or argument.value < 0:
        raise ValueError(f"{name} is a constant number")
    return argument.value


class TextWindows:
    """(text, size, overlap) -> window_no, n_words, window_text.  A null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(text, "text_windows")
        chunking.check_window(_number(size, chunking.SIZE, "size"), _number(overlap, chunking.OVERLAP, "overlap"))
        return AnalyzeResult(_struct(window_no=_INT, n_words=_INT, window_text=_TEXT))

    def eval(self, text: str | None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
        words = [w for w in SPACE.split(text or "") if w]
        at = no = 0
        while words and (no == 0 or at + overlap < len(words)):
            part = words[at : at + size]
            yield no, len(part), " ".join(part)
            at, no = at + size - overlap, no + 1


class Clauses:
    """(content) -> clause_no, label, clause: the clauses of an article."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        _text(content, "clauses")
        return AnalyzeResult(_struct(clause_no=_INT, label=_TEXT, clause=_TEXT))

    def eval(self, content: str | None) -> Iterator[tuple]:
        for no, (label, text) in enumerate(chunking.clauses(content or "")):
            yield no, label, text


class SectionWalk:
    """(TABLE of schemas.BLOCK) -> schemas.SECTION: the walk of a document."""

    @staticmethod
    def analyze(blocks: AnalyzeArgument) -> AnalyzeResult:
        if not blocks.isTable:
            raise ValueError("section_walk takes a table")
        order = [OrderingColumn(c) for c in ("page_number", "source_order", "row_order")]
        return AnalyzeResult(_SECTION, partitionBy=[PartitioningColumn("document_id")], orderBy=order)

    def __init__(self):
        self.document, self.blocks = None, []

    def eval(self, row: Row) -> None:
        self.document = row["document_id"]
        table = row["table_ref"].asDict() if row["table_ref"] is not None else None
        boxes = [b.asDict() for b in row["bbox"] or []]
        self.blocks.append(sections.Block(row["page_number"] or 0, row["block_type"] or "paragraph", row["content"] or "", row["heading_level"], table, row["para_id"], boxes))

    def terminate(self) -> Iterator[tuple]:
        for i, s in enumerate(sections.sections_of(self.blocks)):
            blocks = [(b["para_id"], [tuple(x[k] for k in ("page", "x", "y", "width", "height")) for x in b["bbox"]], b["content"]) for b in s.blocks]
            table = (s.table["table_id"], s.table["row_index"], s.table["headers"]) if s.table else None
            yield self.document, i, s.page, s.kind, s.text, list(s.path), s.heading, table, s.context, blocks


FUNCTIONS = {"text_windows": TextWindows, "clauses": Clauses, "section_walk": SectionWalk}


def register(spark: SparkSession) -> None:
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))
