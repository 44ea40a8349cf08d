"""Normal forms of single strings, for operators that walk through text."""

from __future__ import annotations

import re
import unicodedata


def fold_char(t: str) -> str:
    """Compatibility decomposition without marks, in lower case; what is no mark
    is put together again, so Hangul syllables stay whole."""
    marks = unicodedata.normalize("NFKD", t)
    return unicodedata.normalize("NFC", "".join(c for c in marks if not unicodedata.combining(c)).lower())


def fold_text(t: str | None) -> str:
    return " ".join(fold_char(t or "").split())


def search_text(t: str | None) -> str:
    return re.sub("[‐‑‒–—−]", "-", fold_text(t))


def alnum(t: str | None) -> str:
    return re.sub("[^a-z0-9]", "", fold_text(t))


def canonical_number(t: str | None) -> str:
    t = (t or "").strip().strip(".,")
    if not re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", t) and re.fullmatch(r"\d+[.,]\d+", t):
        whole, part = re.split("[.,]", t)
        return whole + part.rstrip("0")
    return re.sub(r"\D", "", t)
