import random
import re

import numpy as np
import pytest

from folioforge.llm import minhash as M
from folioforge.llm.components import connected_components


def sets_of(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]) and None not in (rows[i][0], rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if d is not None else None, d is None or d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, groups=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["ÄÖ", "É", "Abc"]
    rows, d = [], 1000
    for _ in range(groups):
        base = r.choices(words, k=r.choice([1, 2, 3, 8, 40, 120, 300]))
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((d := d + 1, r.choice([" ", "\n", "\t "]).join(copy)))
    r.shuffle(rows)
    return rows + [(5, None), (6, ""), (7, " \n"), (None, rows[0][1]), rows[1], rows[1]]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, monkeypatch, k, percent):
    rows = corpus(k)
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, rep int").repartition(5)
    want = brute(rows, k, percent)
    assert sorted((tuple(x) for x in M.near_duplicates(df, k, percent).collect()), key=repr) == want
    # of the kept rows, those equal in identifier and text are one
    kept = {(d, t or "") for (d, t) in rows if any(x[0] == d and x[3] for x in want)}
    assert sorted(((x.doc_id, x.text or "") for x in M.drop_near_copies(df, k, percent).collect()), key=repr) == sorted(kept, key=repr)


def test_hub_whose_copies_are_not_linked(spark, monkeypatch):
    """Copies of a base differ at different places: linked to it, not to each other."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 10)
    monkeypatch.setattr(M, "CHUNK", 7)
    r = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    rows = [(900, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for j in range(7):
            copy[r.randrange(200)] = f"x{i}.{j}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in M.near_duplicates(df, 3, 85).collect()), key=repr) == brute(rows, 3, 85)


def test_blocks_leave_out_pairs_within_a_component(spark, monkeypatch):
    """A large component and few others: rows in proportion to the members, and
    every pair of different components in exactly one task."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 10)
    labels = [0] * 200 + list(range(1000, 1008))
    rows = [(7, i, label, 5) for i, label in enumerate(labels)] + [(8, i, 1, 5) for i in range(50)] + [(9, i, i, 5) for i in range(35)]
    out = M._in_blocks(spark.createDataFrame(rows, "bkey long, rep long, label long, n long")).collect()
    assert sum(x.bkey == 7 for x in out) < 3 * 208 and all(x.bkey != 8 for x in out)
    for bkey, n in (7, 208), (9, 35):
        met, of = {}, dict(enumerate(labels)) if bkey == 7 else {i: i for i in range(35)}
        for x in out:
            if x.bkey == bkey:
                met.setdefault((x.lo, x.hi), []).append(x)
        pairs = [(a.rep, b.rep) for (lo, hi), g in met.items() for a in g for b in g if a.own == lo and b.own == hi and (lo < hi or a.rep < b.rep)]
        pairs = [tuple(sorted(p)) for p in pairs if of[p[0]] != of[p[1]]]
        assert len(pairs) == len(set(pairs)) == sum(of[i] != of[j] for i in range(n) for j in range(i))


@pytest.mark.parametrize("giant", [8000, 3])
def test_pages_of_one_template(spark, monkeypatch, giant):
    """Template pages below the threshold share buckets; copies among them are found
    whatever the size from which a bucket is left to the exact filter."""
    monkeypatch.setattr(M, "GIANT", giant)
    monkeypatch.setattr(M, "BLOCK_ROWS", 25)
    r = random.Random(giant)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(70):
        own = [f"o{i}.{j}" for j in range(r.choice([40, 60, 90]))]
        page = template[:150] + own + template[150:]
        rows.append((i, " ".join(page)))
        for c in range(r.choice([0, 0, 1, 2])):
            copy = list(page)
            for _ in range(r.choice([1, 6, 9])):
                copy[r.randrange(len(copy))] = f"c{i}.{c}.{r.random()}"
            rows.append((100 + 3 * i + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 3, 85)
    assert 40 < sum(x[3] for x in want) < len(rows)
    assert sorted((tuple(x) for x in M.near_duplicates(df, 3, 85).collect()), key=repr) == want


@pytest.mark.parametrize("pages,shingles", [(1100, M.BLOCK_SHINGLES), (160, 2000)])
def test_rows_follow_the_members_of_a_bucket(spark, monkeypatch, pages, shingles):
    """Members of a bucket of several blocks (by members or by shingles) are dealt once,
    their texts and what the exact filter compares included."""
    monkeypatch.setattr(M, "BLOCK_SHINGLES", shingles)
    real, dealt = M._in_blocks, []

    def counted(members):
        out = real(members)
        dealt.append(("at" in out.columns, members.count(), out.count()))
        return out

    monkeypatch.setattr(M, "_in_blocks", counted)
    r = random.Random(9)
    template = [f"t{i}" for i in range(50)]
    rows = []
    for i in range(pages):
        page = list(template)
        for j in range(r.choice([1, 2, 4])):
            page[r.randrange(50)] = f"o{i}.{j}"
        rows.append((i, " ".join(page)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(x) for x in M.near_duplicates(df, 3, 85).collect()), key=repr) == brute(rows, 3, 85)
    for exact, members, out in dealt:
        assert out <= (1.5 if exact else 1) * members
    assert {x[0] for x in dealt} == {False, True}


def test_prefix_filter_misses_nothing(spark):
    """The exact filter alone finds every link, bands or not."""
    r = random.Random(2)
    rows = [(d, t) for d, t in corpus(3, 12) if t and t.strip() and d is not None]
    rows = list({d: (d, t) for d, t in rows}.values())
    texts = spark.createDataFrame([(d, d, M.pack(M.minima(M.shingle_set(t, 3))), t) for d, t in rows], "rep long, label long, sig array<long>, text string")
    for percent in (60, 85, 100):
        pairs = M._prefix_pairs(M._prefix_rows(texts, 3, percent), percent)
        got = {(x.a, x.b) for x in M._confirmed(pairs, texts.select("rep", "text"), 3, percent).collect()}
        sets = {d: sets_of(t, 3) for d, t in rows}
        want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert got == want and want


def test_repeated_identifiers_lose_no_text(spark):
    words = [f"w{i}" for i in range(60)]
    same, other, twin = " ".join(words), "a quite unique other text of more than five words", "the twin text has some words of its own"
    rows = [(3, same), (5, same), (5, other), (7, twin), (7, twin), (7, twin + " "), (8, " ".join([*words, "x"])), (8, "one two"), (None, same), (9, None), (9, "")]
    df = spark.createDataFrame([(*x, n) for n, x in enumerate(rows)], "doc_id long, text string, k1 int").repartition(4)
    got = M.drop_near_copies(df)
    assert got.columns == df.columns
    left = sorted(((x.doc_id, (x.text or "").strip()) for x in got.collect()), key=repr)
    assert left == sorted([(3, same), (5, other), (7, twin), (8, "one two"), (None, same), (9, "")], key=repr)
    found = sorted((tuple(x) for x in M.near_duplicates(df.select("doc_id", "text")).collect()), key=repr)
    assert found == brute(rows, 5, 80)


def test_hot_group_of_equal_sets(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text of some words that many share', concat('t', id, ' u', id, ' v w x', id)) as text")
    got = M.near_duplicates(df).where("not kept").collect()
    assert len(got) == 1333 and {x.component_id for x in got} == {0}
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_estimate_follows_similarity():
    r = np.random.default_rng(0)
    for j in (0.0, 0.3, 0.6, 0.85, 1.0):
        got = []
        for _ in range(60):
            n = 600
            both = round(2 * n * j / (1 + j))
            x = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = x[:n], np.concatenate([x[:both], x[n : 2 * n - both]])
            sigs = [np.array([M.pack(M.minima(s))], np.int64).view(np.uint64) for s in (a, b)]
            got.append(M.estimate(int(M._matches(*sigs)[0, 0])))
        assert abs(np.mean(got) - j) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_components_end_with_the_round_that_settles_them(spark, monkeypatch):
    """A settled forest is recognised by its first table of minima; no star is written again."""
    from folioforge.llm import components as C

    made = []
    real = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name, *a, **b: made.append(name) or real(df, name, *a, **b))
    stars = spark.createDataFrame([(i, i % 3) for i in range(50)] + [(7, 1)], "a long, b long")
    assert {x.node: x.label for x in connected_components(stars).collect()} == {i: i % 3 for i in range(50)}
    assert made == ["components", "components-least"]


def test_small_tables_are_few_files(spark):
    """As many tasks write as the rows need, whatever the number of shuffle partitions."""
    from folioforge.llm import common as K

    df = spark.range(10_000).repartition(200, "id")
    got = K.materialize(df, "t", most_rows=10_000)
    assert len(got.inputFiles()) == K.FEW_TASKS and got.agg({"id": "sum"}).first()[0] == 49_995_000
    assert len(K.materialize(df, "t", most_rows=200 * K.TASK_ROWS).inputFiles()) == 200
    assert len(K.materialize(spark.range(100).repartition(5, "id"), "t", most_rows=100).inputFiles()) == 5
