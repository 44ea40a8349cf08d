"""Line dedup by a tree of line templates, in DataFrame operations only.

The tree has a fixed depth: a line goes by its token count, then by its first
``DEPTH`` tokens, to a leaf.  Tokens with digits are variable from the start
(``<*>``).  Within a leaf a token is constant at its position if lines of at least
``SUPPORT`` texts have it there; the others are variable fields too.  A line whose
tokens are constant to ``SHARE`` or more has the generalised line as its template,
any other line is its own template.  A template recurs if ``TEXTS`` different
texts have it (two suffice from ``LONG`` tokens on); recurring lines are dropped
from every text but the first, that of the smallest doc_id.

Most lines are alone in their leaf, and most texts lose nothing.  Bitmaps of a
fixed size tell which lines and texts may matter, so the others are never
shuffled; tokens are looked at only in leaves with several kinds of lines, and as
hashes.  Counts are of different texts, hence copies of one document make no
template.  Leaves are told apart by 64 bits and the token count, lines, texts and
templates by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, bitmap, in_bitmap, join_hot, materialize

DEPTH, SUPPORT, SHARE, TEXTS, LONG = 3, 3, 0.5, 3, 50
VARIABLE = "<*>"
#: Characters below and beside those; a text of them alone is passed over in one loop.
SPACED = r"\A[\x00-\u0dff\u1d00-\u2fff]*+\z"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")


def _masked(text: Column) -> Column:
    """The text with one space between the tokens of a line, none at its ends,
    and VARIABLE for tokens with digits; line ends stay.  A token is tried from the
    space or line end before it.

    Done on whole texts: what is done after lines are split would be evaluated
    again in every filter on it.  The work is linear however long tokens are.
    """
    unspaced = (F.octet_length(text) > F.char_length(text)) & ~text.rlike(SPACED) & text.rlike(f"[{UNSPACED}]")
    odd = text.startswith(" ") | text.endswith(" ") | unspaced
    for part in ("  ", " \n", "\n ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(text, F.lit(part))
    apart = F.when(unspaced, F.regexp_replace(text, f"([{UNSPACED}])", " $1 ")).otherwise(text)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(apart, r"[ \t\r\f\x0B]+", " "), " ?\n ?", "\n"))
    clean = F.when(odd, spaced).otherwise(text)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(clean, r"(^|[ \n])[^ \n0-9]*+[0-9][^ \n]*+", f"$1{VARIABLE}")).otherwise(clean)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, masked (tokens joined by one space), n, leaf."""
    at = docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), F.split(_masked(F.col("text")), "\n").alias("lines"))
    # a text has one line at least; without "outer" a filter on the number of lines would mask every text twice
    at = at.select("doc_id", "text_key", F.posexplode_outer("lines").alias("line_no", "masked"))
    # rules of dashes, brackets, numbers alone tell nothing; most lines begin with a letter
    line = F.col("masked")
    at = at.where(((line >= "A") & (line < "[")) | ((line >= "a") & (line < "{")) | line.rlike(r"\p{L}"))
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return at.withColumn("n", n).withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", DEPTH)))


def _templates(lines: DataFrame) -> DataFrame:
    """line_key, t1, t2, n_rows for the lines of leaves in which tokens must be
    compared.

    A leaf with one kind of line, or with fewer than SUPPORT of them in all,
    makes nothing general: there a line is its own template.
    """
    kinds = lines.groupBy("leaf", "n", "line_key").agg(F.count_distinct("text_key").alias("texts"), F.count("*").alias("n_rows"))
    kinds = materialize(kinds, "line-kinds")
    mixed = kinds.groupBy("leaf", "n").agg(F.count("*").alias("kinds"), F.sum("texts").alias("all"), F.count("*").alias("of_leaf")).where((F.col("kinds") > 1) & (F.col("all") >= SUPPORT))
    mixed = mixed.select("leaf", "n", F.col("of_leaf").alias("n_rows"))
    kinds = join_hot(kinds.withColumnRenamed("n_rows", "rows_of_line"), materialize(mixed, "line-mixed"), ["leaf", "n"], kinds.count()).drop("n_rows")
    words = lines.select("line_key", "masked").dropDuplicates(["line_key"]).join(kinds, "line_key")
    # the leading tokens are those of the leaf: constant, unless variable
    head = F.slice(F.split("masked", " "), 1, DEPTH)
    led = F.size(F.filter(head, lambda t: t != VARIABLE))
    tail = F.posexplode_outer(F.slice(F.split("masked", " "), DEPTH + 1, 1 << 30)).alias("place", "token")
    placed = words.select("leaf", "n", "line_key", "rows_of_line", "texts", led.alias("led"), tail)
    placed = placed.withColumn("token", F.when(F.coalesce(F.col("token"), F.lit(VARIABLE)) != VARIABLE, F.xxhash64("token")))
    placed = materialize(placed, "line-tokens")
    constant = placed.where("token is not null").groupBy("leaf", "n", "place", "token").agg(F.sum("texts").alias("having"), F.count("*").alias("n_rows")).where(F.col("having") >= SUPPORT).drop("having")
    constant = materialize(constant.withColumn("fixed", F.col("token")), "line-constants")
    marked = join_hot(placed, constant, ["leaf", "n", "place", "token"], placed.count(), "left")
    shown = lambda c, salt: F.bit_xor(F.xxhash64("place", F.coalesce(c, F.lit(0).cast("long")), F.lit(salt)))
    whole = marked.groupBy("line_key", "n", "led", "rows_of_line").agg(
        F.count("fixed").alias("fixed"),
        *(shown(F.col(c), salt).alias(f"{c}{salt}") for c in ("fixed", "token") for salt in (1, 2)),
    )
    general = F.col("fixed") + F.col("led") >= SHARE * F.col("n")
    return whole.select("line_key", F.col("rows_of_line").alias("n_rows"), *(F.when(general, F.col(f"fixed{i}")).otherwise(F.col(f"token{i}")).alias(f"t{i}") for i in (1, 2)))


def _marks(numbers: Column) -> Column:
    """Bytes, one per line up to the last number: '1' for the numbers, else '0'."""
    ascending = F.sort_array(numbers)
    gaps = F.zip_with(ascending, F.concat(F.array(F.lit(-1)), ascending), lambda x, before: F.repeat(F.lit("0"), x - before - 1))
    return F.concat(F.array_join(gaps, "1"), F.lit("1")).cast("binary")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: int = TEXTS, keep_first: bool = True) -> DataFrame:
    """Every document without the lines whose template recurs.

    Columns: doc_id, n_lines, n_dropped, text (remaining lines, order kept).
    Lines end at ``\\n``; blank lines and lines without a letter outside variable
    fields (rules, brackets, numbers) are never dropped.  In scripts written
    without spaces every character is a token.  Null text = empty text, which has
    one empty line.  Documents with equal texts get equal results.  Ties for the
    first text cannot occur between different identifiers; rows without one come
    last.  Empty table: empty result.  With ``keep_first`` off the first text
    loses its line too.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = _lines(picked)
    text_hash = F.xxhash64("text_key")
    shared = lines.groupBy("leaf").agg(F.min(text_hash).alias("p"), F.max(text_hash).alias("q")).where("p < q").select("leaf")
    shared = materialize(shared, "line-leaves")
    n_leaves = 2 * shared.count()  # for twice the bits
    # a lone leaf that the bitmap lets through makes no template of several texts
    may = lines.join(F.broadcast(bitmap(shared.select(F.col("leaf").alias("key")), n_leaves, "line-bitmap")), in_bitmap(F.col("leaf")), "left_semi")
    lines = materialize(may.withColumn("line_key", F.unhex(F.md5("masked"))), "line-shared")
    n_lines = lines.count()
    own = [F.coalesce(f"t{i}", F.xxhash64("line_key", F.lit(i))).alias(f"t{i}") for i in (1, 2)]
    placed = join_hot(lines.drop("masked"), materialize(_templates(lines), "line-kinds"), ["line_key"], n_lines, "left")
    placed = materialize(placed.select("leaf", "n", "text_key", "doc_id", "line_no", *own), "line-templates")
    key = ["leaf", "n", "t1", "t2"]
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    recurring = (
        placed.groupBy(*key)
        .agg(F.count_distinct("text_key").alias("having"), F.min_by("text_key", by_id).alias("first_key"), F.count("*").alias("n_rows"))
        .where((F.col("having") >= texts) | ((F.col("having") >= 2) & (F.col("n") >= LONG)))
    )
    gone = join_hot(placed, materialize(recurring.select(*key, "first_key", "n_rows"), "line-recurring"), key, n_lines)
    if keep_first:
        gone = gone.where("text_key <> first_key")
    # a text's own line numbers: bounded by the text; n_rows: the texts equal to it
    gone = gone.groupBy("text_key", "line_no").agg(F.count("*").alias("n")).groupBy("text_key").agg(F.collect_list("line_no").alias("numbers"), F.max("n").alias("n_rows"))
    gone = materialize(gone.select("text_key", F.size("numbers").cast("long").alias("n_gone"), _marks(F.col("numbers")).alias("marks"), "n_rows"), "line-gone")
    bits = F.broadcast(bitmap(gone.select(text_hash.alias("key")), gone.count(), "line-bitmap"))
    keyed, hit = _keyed(picked), in_bitmap(text_hash)
    touched = join_hot(keyed.join(bits, hit, "left_semi"), gone, ["text_key"], picked.count(), "left")
    whole = keyed.join(bits, hit, "left_anti").select("*", F.lit(None).cast("long").alias("n_gone"), F.lit(None).cast("binary").alias("marks"))
    joined = touched.select("doc_id", "text", "n_gone", "marks").union(whole.select("doc_id", "text", "n_gone", "marks"))
    all_lines = F.split("text", "\n")
    left = F.array_join(F.filter(all_lines, lambda x, i: F.substring("marks", i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    return joined.select(
        "doc_id", F.size(all_lines).cast("long").alias("n_lines"), F.coalesce("n_gone", F.lit(0).cast("long")).alias("n_dropped"), F.when(F.col("marks").isNull(), F.col("text")).otherwise(left).alias("text")
    )
