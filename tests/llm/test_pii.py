import math
import random
import re

from pyspark.sql import functions as F

from folioforge.llm import pii as P
from folioforge.llm.queries import pii_digest
from folioforge.llm.secrets import sha256_hex

RULES = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force():
    r = random.Random(6)
    bits = ["a.b", "x@", "@", "y.com", "-", ".", "@d", "1", "12", "255", "256", "0001", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-2485", "+", "+49", " ", "  ", "(", ")", "é", "٣", "\n", "%", "_", "4242-4242-4242-4242", "10.0.0.1"]
    for _ in range(30_000):
        t = "".join(r.choices(bits, k=r.randrange(1, 12)))
        assert P.base_spans(t) == brute(t), t


def test_long_runs_stay_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1-" * 100_000, "+1" * 100_000, "1." * 100_000, "@a" * 100_000, "a@b." * 50_000):
        P.base_spans(t)


def corpus():
    r = random.Random(1)
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golf", "hotel"]
    rows = []
    for i in range(60):
        t = " ".join(r.choices(words, k=8)) + f" unique{i}"
        if i % 10 == 0:
            t += " Zebrafish met jo@ex.org there, Zebrafish"
        if i % 10 == 1:
            t += " okapi here"
        if i % 20 == 10:
            t += " okapi jo@ex.org"
        if i % 15 == 2:
            t += " lemur 10.1.2.3 Kim K9"
        rows.append((i, t))
    copy = "walrus lonely@ex.org " + "x " * 3
    return rows + [(100 + i, copy) for i in range(9)] + [(200, None), (201, ""), (None, rows[0][1]), (0, rows[0][1])]


def brute_terms(rows):
    texts = sorted({t or "" for _, t in rows})
    info = []
    for t in texts:
        spans = brute(t)
        hidden = set().union(*(range(a, e) for a, _, e in spans)) if spans else set()
        inside = {m[0].lower() for m in re.finditer(r"[^\W_]+", t) if not hidden & set(range(m.start(), m.end()))}
        info.append(({(k, t[a:e]) for a, k, e in spans}, inside))
    n, out = len(texts), {}
    for e in set().union(*(x[0] for x in info)):
        ne = sum(e in x[0] for x in info)
        if ne < P.SUPPORT:
            continue
        for t in set().union(*(x[1] for x in info if e in x[0])):
            both, nt = sum(e in x[0] and t in x[1] for x in info), sum(t in x[1] for x in info)
            d = math.log(min(1, both / nt) * n / ne) / math.log(n / ne)
            if both >= P.SUPPORT and d >= P.GENERALISE:
                out[e, t] = d
    return out


def test_terms_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, term int").repartition(4)
    want = brute_terms(rows)
    assert {t for _, t in want} >= {"zebrafish", "lemur", "kim", "k9"} and "walrus" not in {t for _, t in want} and "alpha" not in {t for _, t in want}
    got = P.sanitise(df).collect()
    assert len(got) == len(rows)
    seen = {}
    for x in got:
        seen.setdefault(x.doc_id, []).append(x)
    for i, t in rows:
        x = seen[i][0]
        t = t or ""
        terms = {w for (e, w) in want if (e[0], e[1]) in {(k, t[a:z]) for a, k, z in brute(t)}}
        spans = [(a, P.KINDS[k], e) for a, k, e in brute(t)] + [(m.start(), "term", m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in terms and not any(a < m.end() and m.start() < e for a, _, e in brute(t))]
        assert [(s.start, s.kind, s.end) for s in x.spans] == sorted(spans)
        assert (x.sanitised is None) == (not spans) and (not spans or not re.search("@|Zebra", x.sanitised))
    d = {x.doc_id: x for x in pii_digest(df).collect()}
    assert d[100].has_personal_data and not d[200].has_personal_data
    assert d[100].n_email == 1 and d[100].base_sha256 == sha256_hex("email:7:20") and d[200].spans == ""
    assert P.sanitise(df.limit(0)).count() == 0


def test_corpus_counts_leave_spans_out(spark):
    rows = [(i, f"plain text number {i} about nothing" + " smith@x.org" * (i < 33) + " Smith wrote \u0130zmirli" * (i < 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in P.sanitise(df).where("size(spans) > 0").collect()}
    assert len(got) == 33
    for i, x in got.items():
        text = rows[i][1]
        terms = {text[s.start : s.end] for s in x.spans if s.kind == "term"}
        assert terms == ({"Smith", "wrote", "\u0130zmirli"} if i < 3 else set())
        assert "mith" not in x.sanitised


def test_bitmaps_are_read_as_they_are_written(spark):
    keys = [f"k{i}\u00e9" for i in range(5000)]
    bits = P._bits(spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k").alias("key")), 5000)
    assert all(P.passes(bits, k.encode()) for k in keys)
    assert sum(P.passes(bits, f"other{i}".encode()) for i in range(5000)) < 1000


def test_text_with_many_entities_and_terms(spark):
    """Only entities and terms with support and a chance of disclosure meet."""
    mails, words = " ".join(f"m{i}@x.org" for i in range(3000)), " ".join(f"w{i}" for i in range(3000))
    rows = [(i, f"common words of text {i} " + (f"telling m{i % 5}@x.org" if i < 20 else "")) for i in range(200)] + [(1000, f"{mails} {words}")]
    got = {x.doc_id: x for x in P.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len([s for s in got[1000].spans if s.kind == "email"]) == 3000 and not [s for s in got[1000].spans if s.kind == "term"]
