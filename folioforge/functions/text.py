"""Normal forms of text as Column expressions; one place for all of them."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plain import fold_char

DASHES = "‐‑‒–—−"


#: Where letters stand that decompose; Hangul and ideographs stay whole.
DECOMPOSED = ((0x80, 0x3400), (0xA640, 0xAC00), (0xF900, 0x20000))
#: Stand-ins for characters that become several: private use, plane 16.
STAND_INS = 0x100000
_STAND_IN = "[\\x{100000}-\\x{10FFFF}]"


@cache
def fold_table() -> tuple[str, str, str]:
    """Characters, what stands for each of the first of them (the rest go), and a
    JSON object of stand-ins with their several characters; by the rule of
    :func:`~folioforge.functions.plain.fold_char`."""
    singles: dict[str, str] = {}
    gone, several = [], {}
    for first, end in DECOMPOSED:
        for c in map(chr, range(first, end)):
            if c != c.lower() or (to := fold_char(c)) == c:
                continue  # what has a lower form is lowered before
            if len(to) == 1:
                singles[c] = to
            elif to:
                singles[c] = chr(STAND_INS + len(several))
                several[singles[c]] = to
            else:
                gone.append(c)
    return "".join([*singles, *gone]), "".join(singles.values()), json.dumps(several, ensure_ascii=False)


def fold(c: Column) -> Column:
    """Lower case, compatibility decomposition, without marks; stays in the JVM.

    Equals ``fold_text`` without its spaces.  Plain ASCII is only lowered.
    """
    chars, to, several = fold_table()
    parts = F.from_json(F.lit(several), "map<string,string>")
    bound = F.array(F.translate(F.lower(c), chars, to))
    first = lambda x: F.substring(x, 1, 1)
    one = lambda x: F.concat(F.coalesce(F.try_element_at(parts, first(x)), first(x)), F.substring(x, 2, 1 << 30))
    whole = lambda t: F.array_join(F.transform(F.split(t, f"(?={_STAND_IN})"), one), "")
    folded = F.get(F.transform(bound, lambda t: F.when(t.rlike(_STAND_IN), whole(t)).otherwise(t)), F.lit(0))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(folded)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def matching_form(c: Column) -> Column:
    """For term matching: folded, punctuation as space, spaces collapsed."""
    return collapse(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_\s]", " "))


def grounding_form(c: Column) -> Column:
    """For literal citations: folded and collapsed, punctuation kept."""
    return collapse(fold(c))


def search_form(c: Column) -> Column:
    """The grounding form with all dashes alike."""
    return F.translate(grounding_form(c), DASHES, "-" * len(DASHES))


def alnum_form(c: Column) -> Column:
    """Only a-z and 0-9 of the folded text."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    """Words between white space; none of an empty or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def n_tokens(c: Column) -> Column:
    return F.size(tokens(c))


def null_if_empty(c: Column) -> Column:
    """Empty text, like null, gives way to the next value of a coalesce."""
    return F.when(c != "", c)


def canonical_number(c: Column) -> Column:
    """One form for the ways to write a number: thousands separators go, a
    decimal part loses its separator and the zeros at its end; of anything else
    the digits remain."""
    t = F.regexp_replace(F.trim(c), r"^[.,]+|[.,]+$", "")
    digits = F.regexp_replace(t, r"\D", "")
    decimal = F.concat(F.regexp_extract(t, r"^(\d+)", 1), F.regexp_replace(F.regexp_extract(t, r"[.,](\d+)$", 1), "0+$", ""))
    return F.when(t.rlike(r"^\d{1,3}([.,]\d{3})+$"), digits).when(t.rlike(r"^\d+[.,]\d+$"), decimal).otherwise(digits)


def page_number(c: Column) -> Column:
    """The first run of digits, 0 without any."""
    return F.coalesce(F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("int"), F.lit(0))


def dehyphenate(c: Column) -> Column:
    """Joins words that a line end cuts after a hyphen."""
    return F.regexp_replace(c, r"(?<=\p{L})-\n(?=\p{L})", "")


def unescape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\`*_{}\[\]()#+\-.!|~>])", "$1")


#: What must not reach a log (fixed values): the value after each of these.
REDACTED = (
    r"(?i)(api[_-]?key\s*[=:]\s*)([^\s,;]+)",
    r"(?i)(token\s*[=:]\s*)([^\s,;]+)",
    r"(?i)(sig=)([^&\s]+)",
    r"(?i)(password\s*[=:]\s*)([^\s,;]+)",
    r"(?i)(accountkey=)([^;\s]+)",
)


def redact(c: Column) -> Column:
    for pattern in REDACTED:
        c = F.regexp_replace(c, pattern, "$1***")
    return c


def strip_query(c: Column) -> Column:
    """A URL without its query; a fragment stays."""
    return F.regexp_replace(c, r"^([^?#]*)\?[^#]*", "$1")
