"""From blocks with their section to chunks: windows, packing, parents and children."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import collapse, fold, tokens

SIZE, OVERLAP = 700, 120
PARENT_CHARS, CHILD_CHARS = 800, 100
#: Fixed value, the start of a clause inside an article: "a)", "iv)", "2." or "2)".
CLAUSE = re.compile(r"^([a-z]\)|[ivxIVX]+\)|[0-9]+[.)])\s+(.+)", re.M)


def check_window(size: int, overlap: int) -> None:
    if size <= overlap:
        raise ValueError(f"windows of {size} words cannot overlap by {overlap}")


def windows(words: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of word arrays: overlapping windows that stop once one reaches the end."""
    check_window(size, overlap)
    step = size - overlap
    n = F.size(words)
    last = F.when(n > size, F.ceil((n - size) / step) * step).otherwise(F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(words, i + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<string>>"))


def window_rows(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per window: the other columns, window_no, n_words, window_text.

    The words are a generated column: as an expression they would be made again
    for every window.
    """
    split = docs.select("*", F.explode(F.array(tokens(F.col(text)))).alias("__t")).drop(text)
    cut = split.withColumn("__w", windows(F.col("__t"), size, overlap)).drop("__t")
    rows = cut.select("*", F.posexplode("__w").alias("window_no", "__words")).drop("__w")
    return rows.withColumn("n_words", F.size("__words")).withColumn("window_text", F.array_join("__words", " ")).drop("__words")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines; the lines of a text that has no such part."""
    cut = lambda by: F.filter(F.transform(F.split(c, by), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(cut("\n\n")) > 0, cut("\n\n")).otherwise(cut("\n"))


def pack(parts: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of whole paragraphs of at most ``size`` words.

    What a piece ends with is repeated at the start of the next while it fits in
    the overlap and leaves room for the paragraph that comes; a paragraph above
    ``size`` stands alone, in overlapping windows.
    """
    check_window(size, overlap)
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for p in parts:
        words = p.split()
        n = len(words)
        if n > size:
            if held:
                out.append("\n\n".join(x for x, _ in held))
                held = []
            at = 0
            while True:
                out.append(" ".join(words[at : at + size]))
                if at + size >= n:
                    break
                at += size - overlap
            continue
        if held and sum(k for _, k in held) + n > size:
            out.append("\n\n".join(x for x, _ in held))
            room, tail = min(overlap, size - n), 0
            while tail < len(held) and sum(k for _, k in held[len(held) - tail - 1 :]) <= room:
                tail += 1
            held = held[len(held) - tail :]
        held.append((p, n))
    if held:
        out.append("\n\n".join(x for x, _ in held))
    return out


def packed(parts: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<string> of paragraphs -> array<string> of pieces (row by row, Arrow batches)."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else pack(list(x), size, overlap))

    return run(parts)


def clauses(content: str) -> list[tuple[str, str]]:
    """(label, text) of the clauses of an article; none unless there are two or
    more and each is substantial."""
    starts = list(CLAUSE.finditer(content))
    if len(starts) < 2:
        return []
    ends = [m.start() for m in starts[1:]] + [len(content)]
    out = [(m[1], content[m.start() : e].strip()) for m, e in zip(starts, ends)]
    return out if all(len(t) >= CHILD_CHARS for _, t in out) else []


def blocks_of(piece: Column, blocks: Column) -> Column:
    """The source blocks whose text is in the piece; all of them if none is."""
    form = lambda c: F.array(collapse(fold(c)))
    # the piece's form is a variable, so it is made once for all blocks
    of = lambda f: F.filter(blocks, lambda b: F.contains(f, collapse(fold(b["content"]))) & (F.trim(b["content"]) != ""))
    inside = F.get(F.transform(form(piece), of), F.lit(0))
    return F.when(F.size(inside) > 0, inside).otherwise(blocks)


CHUNK = "piece_no int, child_no int, chunk_type string, title string, content string, token_count int"


def create_chunks(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of merged sections.

    In: document_id, block_no, page_number, block_type, content, heading_path,
    table_context (may be null), blocks.  Out: those keys with chunk_index (in
    reading order, children after their parent), chunk_type normal | parent |
    child, parent_chunk_index, title, section_path, content, token_count, blocks.
    A section that is only a heading gives that heading as content; a section
    without both gives nothing.
    """
    check_window(size, overlap)
    schema = f"document_id string, block_no int, {CHUNK}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, b, kind, content, path, context in f.itertuples(index=False):
                path = list(path) if path is not None else []
                title = path[-1] if path else None
                content = content or title or ""
                pieces = [content] if kind == "table" else pack([p.strip() for p in content.split("\n\n") if p.strip()], size, overlap)
                for i, piece in enumerate(p for p in pieces if p.strip()):
                    if kind == "table" and context:
                        piece = f"{context}\n{piece}"
                    inner = clauses(piece) if len(piece) >= PARENT_CHARS and kind != "table" else []
                    rows.append((d, b, i, -1, "parent" if inner else "normal", title, piece, len(piece.split())))
                    rows += [(d, b, i, k, "child", f"{title}.{label}" if title else label, t, len(t.split())) for k, (label, t) in enumerate(inner)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    made = sections.select("document_id", "block_no", "block_type", "content", "heading_path", "table_context").mapInPandas(run, schema)
    by_doc = Window.partitionBy("document_id").orderBy("block_no", "piece_no", "child_no")
    made = made.withColumn("chunk_index", F.row_number().over(by_doc) - 1)
    piece = Window.partitionBy("document_id", "block_no", "piece_no").orderBy("child_no")
    made = made.withColumn("parent_chunk_index", F.when(F.col("chunk_type") == "child", F.first("chunk_index").over(piece)))
    more = [c for c in ("table_ref",) if c in sections.columns]
    keys = sections.select("document_id", "block_no", "page_number", "block_type", "heading_path", "blocks", *more)
    path = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise("general")
    return made.join(keys, ["document_id", "block_no"]).withColumn("section_path", path).withColumn("blocks", blocks_of(F.col("content"), F.col("blocks"))).drop("piece_no", "child_no")


def with_document(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds filename and is_primary of the chunk's document (null if unknown)."""
    return chunks.join(documents.select("document_id", "filename", "is_primary"), "document_id", "left")


def page_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id").agg(F.max("page_number").alias("page_count"))
