"""Secret scan through a trigram inverted index.

For every rule a Boolean query over trigrams is derived from its regular
expression: any text that the rule matches satisfies the query.  Documents are
indexed in blocks; the index of a block lists, for each trigram that some query
mentions, the documents of the block that hold it.  Posting lists are
intersected and united as the query says, and only the documents that remain
are verified with the rule itself.  A rule whose expression guarantees no
trigram (a long run of hexadecimal digits, say) has the query TRUE and scans the
whole block.

A block is a slice of a task's rows with a few megabytes of text, so building,
querying and verifying is one pass without a shuffle and with bounded memory.  The
trigrams of a block are looked up once for all rules together; more rules make
the table of wanted trigrams larger, not the number of passes.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

# Boolean queries: True, False, a trigram, or ("and" | "or", frozenset of queries)

#: Bytes of text whose trigrams are looked up at a time.
WINDOW = 1 << 20
MAX_EXACT = 24
MAX_CLASS = 8


def _all(parts: Iterable) -> object:
    flat: set = set()
    for p in parts:
        if p is False:
            return False
        if p is not True:
            flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(parts: Iterable) -> object:
    flat: set = set()
    for p in parts:
        if p is True:
            return True
        if p is not False:
            flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    return False if not flat else next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of_string(s: str) -> object:
    return _all(s[i : i + 3] for i in range(len(s) - 2))


def _of_strings(strings: Iterable[str]) -> object:
    return _any(_of_string(s) for s in strings)


@dataclass(frozen=True)
class Info:
    """What is known of the (lower-cased) strings that an expression matches.

    ``exact``: all of them, if they are few; else None.  Otherwise each starts
    with one of ``prefix``, ends with one of ``suffix``, and satisfies ``match``.
    """

    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    match: object


ANYTHING = Info(None, frozenset({""}), frozenset({""}), True)
EMPTY = Info(frozenset({""}), frozenset({""}), frozenset({""}), True)


def _exact(strings: Iterable[str]) -> Info:
    s = frozenset(x.lower() for x in strings)
    return _trim(Info(s, s, s, True))


def _trim(i: Info) -> Info:
    """Give up exactness where it grows; keep its trigrams first."""
    if i.exact is not None and len(i.exact) <= MAX_EXACT:
        return i
    match = _all([i.match, _of_strings(i.exact)]) if i.exact is not None else i.match
    prefix, suffix = i.prefix, i.suffix
    match = _all([match, _of_strings(prefix), _of_strings(suffix)])
    prefix, suffix = frozenset(x[:2] for x in prefix), frozenset(x[-2:] for x in suffix)
    none = frozenset({""})
    return Info(None, prefix if len(prefix) <= MAX_EXACT else none, suffix if len(suffix) <= MAX_EXACT else none, match)


def _then(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= 4 * MAX_EXACT:
        both = frozenset(x + y for x in a.exact for y in b.exact)
        return _trim(Info(both, both, both, _all([a.match, b.match])))
    seam = True
    if len(a.suffix) * len(b.prefix) <= 16 * MAX_EXACT:
        seam = _of_strings(x + y for x in a.suffix for y in b.prefix)
    own = [a.match, b.match, seam]
    own += [_of_strings(i.exact) for i in (a, b) if i.exact is not None]
    prefix = frozenset(x + y for x in a.exact for y in b.prefix) if a.exact is not None else a.prefix
    suffix = frozenset(x + y for x in a.suffix for y in b.exact) if b.exact is not None else b.suffix
    return _trim(Info(None, prefix, suffix, _all(own)))


def _either(infos: list[Info]) -> Info:
    exact = None
    if all(i.exact is not None for i in infos):
        exact = frozenset().union(*(i.exact for i in infos))
        match = True if len(exact) <= MAX_EXACT else _any(_all([i.match, _of_strings(i.exact)]) for i in infos)
    else:
        match = _any(_all([i.match, _of_strings(i.exact) if i.exact is not None else True]) for i in infos)
    return _trim(Info(exact, frozenset().union(*(i.prefix for i in infos)), frozenset().union(*(i.suffix for i in infos)), match))


def _analyse(tree) -> Info:
    return reduce(_then, (_node(op, arg) for op, arg in tree), EMPTY)


def _node(op, arg) -> Info:
    if op is sre.LITERAL:
        return _exact([chr(arg)])
    if op is sre.IN:
        chars: list[str] = []
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.append(chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < MAX_CLASS:
                chars += map(chr, range(x[0], x[1] + 1))
            else:
                return ANYTHING
        return _exact(chars) if len(chars) <= MAX_CLASS else ANYTHING
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        return _either([_analyse(x) for x in arg[1]])
    if op is sre.ATOMIC_GROUP:
        return _analyse(arg)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        body = _analyse(inner)
        if least == 0:
            return _either([EMPTY, body]) if most == 1 else ANYTHING
        same = reduce(_then, [body] * min(least, 4))
        return same if least == most and least <= 4 else _then(same, ANYTHING)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return EMPTY
    return ANYTHING


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The query over lower-cased trigrams that every match of ``pattern`` satisfies."""
    i = _analyse(sre_parse.parse(pattern, flags))
    return _all([i.match, _of_strings(i.exact)]) if i.exact is not None else _all([i.match, _of_strings(i.prefix), _of_strings(i.suffix)])


def trigrams_of(query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*(trigrams_of(q) for q in query[1]))
    return {query} if isinstance(query, str) else set()


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, the group whose length counts, its least length."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


#: In order: the three base rules, then further kinds of credentials.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]++", re.ASCII, 0, 32),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        # letters outside ASCII may fold to ASCII ones; such a rule scans fully
        self.queries = [True if r.flags & re.IGNORECASE and not r.flags & re.ASCII else trigram_query(r.pattern, r.flags) for r in rules]
        self.vocabulary = sorted(g for g in set().union(*(trigrams_of(q) for q in self.queries)) if g.isascii())
        self.codes = np.array([int.from_bytes(g.encode(), "big") for g in self.vocabulary], np.uint32)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True
        # a run that is too short is dropped in the expression already, which
        # keeps every other match where it was
        self.compiled = [re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}+" % r.least if r.kind == "hex" else r.pattern, r.flags) for r in rules]

    def index(self, texts: list[str]) -> dict[str, np.ndarray]:
        """trigram -> ascending numbers of the texts that hold it in either case,
        from one pass over the trigrams of all texts."""
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\0\0".join([*parts, b""]).lower(), np.uint8)
        if not len(self.codes) or len(raw) < 3:
            return {g: np.empty(0, np.int64) for g in self.vocabulary}
        starts = np.cumsum([0, *(len(p) + 2 for p in parts)])
        pairs = [np.empty(0, np.int64)]
        for first in range(0, len(raw) - 2, WINDOW):
            part = raw[first : first + WINDOW + 2]
            code = part[:-2].astype(np.uint32)
            for ahead in (part[1:-1], part[2:]):
                code <<= 8
                code |= ahead
            at = np.flatnonzero(self.wanted[code])
            text = np.searchsorted(starts, at + first, side="right") - 1
            pairs.append(np.unique(np.searchsorted(self.codes, code[at]) * len(texts) + text))
        pair = np.unique(np.concatenate(pairs))
        trigram, text = np.divmod(pair, len(texts))
        ends = np.searchsorted(trigram, np.arange(len(self.codes) + 1))
        return {g: text[ends[i] : ends[i + 1]] for i, g in enumerate(self.vocabulary)}

    def candidates(self, query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if query is False:
            return np.empty(0, np.int64)
        if isinstance(query, str):
            return postings[query] if query in postings else np.arange(n)
        lists = sorted((self.candidates(q, postings, n) for q in query[1]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), lists)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, number of the rule, end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index(texts)
        for k, (rule, query, compiled) in enumerate(zip(self.rules, self.queries, self.compiled)):
            for n in self.candidates(query, postings, len(texts)).tolist():
                for m in compiled.finditer(texts[n]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[n].append((m.start(), k, m.end()))
        for f in found:
            f.sort()
        return found


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def posting_lists(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index itself: block, trigram, postings array<long> (doc_ids of a block).

    A block is numbered by its partition and its place in it; doc_ids are in the
    order of the block's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        block = TaskContext.get().partitionId() << 32
        for b in text_slices(batches, 1):
            ids = b.column(0).to_pylist()
            held = [(g, [ids[n] for n in p]) for g, p in s.index([t or "" for t in b.column(1).to_pylist()]).items() if len(p)]
            cols = [pa.array([block] * len(held), pa.int64()), pa.array([g for g, _ in held], pa.string()), pa.array([p for _, p in held], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["block", "trigram", "postings"])
            block += 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "block long, trigram string, postings array<long>")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mask: str | None = "[{kind}]", with_text: bool = True) -> DataFrame:
    """Secrets in every whole text.

    Columns: doc_id, spans array<struct<kind, start, end>> (code points, end
    exclusive, by start, then by the order of the rules) and, ``with_text``,
    masked: the text with every span replaced (overlapping ones as one, by the
    kind that starts first).  Null text = empty text without spans.  Spans of
    different kinds may overlap; within a kind the leftmost comes first and a
    match that fails its length test is dropped without another try.  Rows are
    independent of each other.
    """
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>" + ", masked string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in text_slices(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = s.scan(texts)
            spans = [[{"kind": rules[k].kind, "start": a, "end": e} for a, k, e in f] for f in found]
            cols = [b.column(0).cast(pa.int64()), pa.array(spans, pa.list_(pa.struct(fields)))]
            if with_text:
                cols.append(pa.array([_masked(t, f, rules, mask) for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "spans", "masked"][: len(cols)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _masked(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], mask: str) -> str:
    out, at = [], 0
    for a, k, e in spans:
        if a >= at:
            out += [text[at:a], mask.format(kind=rules[k].kind)]
        at = max(at, e)
    return "".join([*out, text[at:]])


def span_digest(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end joined by commas; only of ``kinds`` if given."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
