"""Categories of chunks: headings first, then weighted glossary terms.

A glossary is configuration of bounded size, so it is compiled into expressions:
no join, no shuffle, one pass over the text inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.plain import fold_text
from folioforge.functions.text import matching_form, n_tokens

SATURATION, DENSITY = 4.0, 1.0
PRIMARY, SECONDARY, RIVAL = 0.25, 0.12, 0.85
#: Terms that a glossary may have in all; more belong into a join.
MOST_TERMS = 5000


@dataclass(frozen=True)
class Category:
    name: str
    terms: tuple[str, ...]
    headings: tuple[str, ...] = ()
    weight: float = 1.0
    primary: float = PRIMARY
    secondary: float = SECONDARY
    top_k: int | None = None


def dedupe_terms(terms: Sequence[str]) -> list[str]:
    """First spelling of each term, regardless of case; blanks go."""
    out: dict[str, str] = {}
    for t in (x.strip() for x in terms):
        if t:
            out.setdefault(t.lower(), t)
    return list(out.values())


def keyword_query(c: Category) -> str:
    return " ".join(dedupe_terms(c.terms))


def top_k(c: Category, default: int = 25) -> int:
    return c.top_k or default


def check_glossary(glossary: Sequence[Category]) -> None:
    names = [c.name for c in glossary]
    if len(set(names)) < len(names):
        raise ValueError("a category occurs twice")
    if sum(len(c.terms) for c in glossary) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")


def _folded(term: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", fold_text(term)).split())


def padded_form(content: Column) -> Column:
    """The matching form with a space at each end.

    It has single spaces, so a word and a phrase are the same test.
    """
    return F.concat(F.lit(" "), matching_form(content), F.lit(" "))


def form_hits(form: Column, terms: Sequence[str]) -> Column:
    found = [F.contains(form, F.lit(f" {t} ")).cast("int") for t in dict.fromkeys(filter(None, map(_folded, terms)))]
    return reduce(lambda a, b: a + b, found, F.lit(0))


def matches(content: Column, terms: Sequence[str]) -> Column:
    """How many different terms the text has: whole words, phrases in order."""
    # the form is a variable: as an expression it would be made for each term
    return F.get(F.transform(F.array(padded_form(content)), lambda form: form_hits(form, terms)), F.lit(0))


def term_counts(chunks: DataFrame, glossary: Sequence[Category], content: str = "content") -> DataFrame:
    """Adds hits: a struct with the number of terms of each category."""
    formed = chunks.select("*", F.explode(F.array(padded_form(F.col(content)))).alias("__form"))
    return formed.withColumn("hits", F.struct(*[form_hits(F.col("__form"), c.terms).alias(c.name) for c in glossary])).drop("__form")


def density_score(m: Column, words: Column, weight: float) -> Column:
    """Breadth of terms times their density per hundred words, at most 1."""
    breadth = F.least(m / SATURATION, F.lit(1.0))
    density = F.least(m / F.greatest(words / 100.0, F.lit(1.0)) / DENSITY, F.lit(1.0))
    return F.least(F.lit(1.0), breadth * density * weight)


def heading_category(path: Column, glossary: Sequence[Category]) -> Column:
    """From the innermost heading outwards, the first that has a pattern.

    Within a heading the category with most patterns wins, then the earliest
    pattern, then the order of the glossary.
    """
    chosen = [c for c in glossary if c.headings]
    if not chosen:
        return F.lit(None).cast("string")

    def one(text: Column) -> Column:
        ranks = []
        for no, c in enumerate(chosen):
            at = [F.instr(text, _folded(p)) for p in c.headings]
            hits = reduce(lambda a, b: a + b, [(x > 0).cast("int") for x in at])
            # least() skips nulls
            first = F.least(*[F.when(x > 0, x) for x in at], F.lit(1 << 30))
            ranks.append(F.when(hits > 0, F.struct((-hits).alias("n"), first.alias("at"), F.lit(no).alias("no"), F.lit(c.name).alias("name"))))
        return F.array_min(F.array(*ranks))["name"]

    found = F.filter(F.transform(F.transform(F.reverse(path), matching_form), one), lambda x: x.isNotNull())
    return F.get(found, 0)


def classify(chunks: DataFrame, glossary: Sequence[Category], content: str = "content", path: str | None = "heading_path") -> DataFrame:
    """Adds scores (struct of one double per category), primary_category,
    secondary_categories, rivals (categories within 15 % of the best score).

    Primary: the category of the headings, else the best score that reaches its
    threshold (ties: order of the glossary), else null.  Secondary: the others
    that reach theirs, in that order.
    """
    check_glossary(glossary)
    counted = term_counts(chunks, glossary, content).withColumn("__n", n_tokens(F.col(content)))
    scored = counted.withColumn("scores", F.struct(*[density_score(F.col(f"hits.{c.name}"), F.col("__n"), c.weight).alias(c.name) for c in glossary])).drop("hits", "__n")
    of = lambda c: F.col(f"scores.{c.name}")
    able = F.array(*[F.when((of(c) >= c.primary) & (of(c) > 0), F.struct((-of(c)).alias("s"), F.lit(no).alias("no"), F.lit(c.name).alias("name"))) for no, c in enumerate(glossary)])
    by_words = F.array_min(able)["name"]
    by_heading = heading_category(F.col(path), glossary) if path else F.lit(None).cast("string")
    top = F.greatest(*map(of, glossary)) if len(glossary) > 1 else of(glossary[0])
    listed = lambda cond: F.filter(F.array(*[F.when(cond(c), c.name) for c in glossary]), lambda x: x.isNotNull())
    out = scored.withColumn("primary_category", F.coalesce(by_heading, by_words))
    out = out.withColumn("secondary_categories", listed(lambda c: (of(c) >= c.secondary) & (of(c) > 0) & ~F.col("primary_category").eqNullSafe(c.name)))
    return out.withColumn("rivals", listed(lambda c: (of(c) >= RIVAL * top) & (top > 0)))
