"""Review tracking: items to review, their states, comments and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOWED = {"not_reviewed": ("in_review", "closed"), "in_review": ("closed",), "closed": ("in_review",)}
CATEGORIES = 7


def item_id(*parts: Column) -> Column:
    """24 characters of a digest over the parts; null is empty."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.left(F.sha2(F.concat_ws("|", *text), 256), F.lit(24))


def citation_hash(c: Column) -> Column:
    return F.left(F.sha2(F.coalesce(c, F.lit("")), 256), F.lit(16))


def seed(versions: DataFrame, actionable: Sequence[str]) -> DataFrame:
    """Items to review of each version: version_id, category_key, item arrays
    (struct<tipo, valor, citation, document_id, page_number>) -> one row per item."""
    rows = versions.where(F.col("category_key").isin(*actionable)).select("version_id", "category_key", F.posexplode("items").alias("position", "item"))
    key = item_id(F.col("version_id"), F.col("category_key"), F.col("position"), F.col("item.tipo"), F.col("item.valor"), F.col("item.document_id"), F.col("item.page_number"), citation_hash(F.col("item.citation")))
    return rows.select("version_id", "category_key", "position", key.alias("tracking_item_id"), F.lit("not_reviewed").alias("status"))


def allowed(current: Column, target: Column) -> Column:
    out = F.lit(False)
    for a, bs in ALLOWED.items():
        out = out | ((current == a) & target.isin(*bs))
    return out


def replay(events: DataFrame, key: Sequence[str], order: Sequence[str], target: str) -> DataFrame:
    """Walks the requests of each key in order: adds accepted, state (after it).

    From every state each of the others can be asked for but not_reviewed, and
    asking for the present one is refused.  So a request is accepted exactly if
    it differs from the last request before it that names in_review or closed
    (not_reviewed, if none does), and the state is the last such request: two
    windows, nothing to walk.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    asked = F.when(F.col(target).isin("in_review", "closed"), F.col(target))
    before = F.coalesce(F.last(asked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("not_reviewed"))
    now = F.coalesce(F.last(asked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("not_reviewed"))
    return events.withColumn("accepted", F.coalesce(asked != before, F.lit(False))).withColumn("state", now)


def summary(categories: DataFrame, key: str, total: int = CATEGORIES) -> DataFrame:
    """Counts per state; whole percent closed."""
    n = {s: F.count_if(F.col("status") == s) for s in ALLOWED}
    share = F.bround(100.0 * n["closed"] / total).cast("int")
    return categories.groupBy(key).agg(*[c.alias(s) for s, c in n.items()], share.alias("closed_percent"))


def comments(rows: DataFrame, users: DataFrame, analysis: str, category: str, tracking_item: str | None = None) -> DataFrame:
    """Comments in order of time, with names; deleted ones are left out."""
    kept = rows.where((F.col("analysis_id") == analysis) & (F.col("category_key") == category) & ~F.coalesce("deleted", F.lit(False)))
    kept = kept.where(F.col("tracking_item_id") == tracking_item) if tracking_item else kept
    names = users.select(F.col("user_id").alias("created_by"), "name")
    return kept.join(names, "created_by", "left").orderBy("created_at", "comment_id")


def comment_counts(items: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every item with its number of comments, 0 included."""
    n = rows.where(~F.coalesce("deleted", F.lit(False))).groupBy(*key).agg(F.count("*").alias("n_comments"))
    return items.join(n, list(key), "left").na.fill(0, ["n_comments"])


def valid_comment(content: Column) -> Column:
    return F.length(F.trim(content)).between(1, 2000)


def field_states(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of found, partial, missing; whether someone must look."""
    s = F.col("extraction_status")
    out = items.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(s == "success").alias("found"), F.count_if(s == "partial").alias("partial"), F.count_if(s.isin("not_found", "failed")).alias("missing"))
    return out.withColumn("needs_review", (F.col("partial") > 0) | (F.col("missing") > 0))


def timeline(rows: DataFrame, date: str, today: Column, least_days: int = 14) -> DataFrame:
    """Days with their rows: position between first and last (0..1), past or not.

    Dates that cannot be read come as one undated day.  The span is at least
    ``least_days``.
    """
    d = F.try_to_date(F.col(date).cast("string"))
    days = rows.groupBy(d.alias("day")).agg(F.count("*").alias("n"))
    ends = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))  # one row
    span = F.greatest(F.datediff("hi", "lo"), F.lit(least_days))
    out = days.crossJoin(F.broadcast(ends))
    return out.select("day", "n", F.round(F.datediff("day", "lo") / span, 6).alias("position"), (F.col("day") < today).alias("past"))
