import random

import pytest

from folioforge.llm import decontaminate as D


def corpus(seed=0):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(6000)]
    items = []
    for i in range(60):
        q = " ".join(r.choices(words, k=r.choice([8, 20, 45, 150])))
        items.append((i, q if i % 2 else q + ".\n" + " ".join(r.choices(words, k=r.choice([1, 3, 12])))))
    items += [(60, None), (61, ""), (62, "two words")]
    rows = []
    for d in range(150):
        w = r.choices(words, k=r.choice([0, 5, 60, 130, 700]))
        if d % 3 == 0:
            x = D.words_of(items[r.randrange(60)][1])
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                x[r.randrange(len(x))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = [y.upper() + "," for y in x]
        rows.append((d, " ".join(w)))
    return rows + [(500, None), (501, ""), (None, items[0][1]), (3, rows[0][1])], items


def brute(rows, items):
    """Verification of every item against every document."""
    out = set()
    for d, text in rows:
        w = D.words_of(text)
        for i, item in items:
            def part(x):
                p = D.shingles(D.words_of(x))
                return None if not p else len(p & D.shingles(w, len(next(iter(p))))) / len(p)

            whole = part(item)
            if whole is None:
                continue
            q, a = map(part, D.split_item(item))
            if whole >= 0.8 or (a is not None and q is not None and q >= 0.8 and a >= 0.8):
                out.add((d, i))
    return out


def scores(index, terms):
    s = {}
    for t in terms:
        for u, w in zip(index.units[t], index.weights[t]):
            s[u] = s.get(u, 0.0) + w
    return s


def test_wand_retrieves_all_above_threshold(monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    rows, items = corpus(1)
    index = D.Index([x for x in items if x[1]])
    r = random.Random(4)
    for _ in range(300):
        terms = r.sample(range(len(index.ids)), r.randrange(1, 60))
        for theta in (0.05, 0.2, 0.5):
            want = {u: s for u, s in scores(index, terms).items() if s >= theta}
            got = index.wand(terms, theta)
            assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in got)


def test_bound_skips_no_passage():
    rows, items = corpus(2)
    index = D.Index([x for x in items if x[1]])
    import numpy as np

    for _, text in rows:
        w = [index.ids.get(x, -1) for x in D.words_of(text)]
        ok = set(index.passages(np.array(w, np.int64), [len(w)]))
        for at in range(0, len(w), D.UNIT):
            if max(scores(index, set(w[at : at + 2 * D.UNIT]) - {-1}).values(), default=0) >= D.THETA:
                assert (0, at) in ok


@pytest.mark.parametrize("shard", [D.SHARD_BYTES, 4000])
def test_against_brute_force(spark, shard):
    rows, items = corpus(3)
    docs = spark.createDataFrame([(*x, 0.0) for x in rows], "doc_id long, text string, score double")
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert {(x.doc_id, x.item_id) for x in D.contaminated_pairs(docs, tests, shard).collect()} == want
    flags = D.flag_contaminated(docs, tests, shard).collect()
    assert len(flags) == len(rows)
    for x in flags:
        assert x.item_ids == sorted(i for d, i in want if d == x.doc_id) and x.contaminated == bool(x.item_ids)
    kept = D.drop_contaminated(docs, tests, shard)
    assert kept.columns == docs.columns and kept.count() == sum(not {p for p in brute([x], items)} for x in rows)
    assert D.flag_contaminated(docs.limit(0), tests).count() == 0
    assert D.flag_contaminated(docs, tests.limit(0)).where("contaminated").count() == 0


def test_parts_far_apart():
    r = random.Random(9)
    rare = [f"r{i}" for i in range(4000)]
    common = [f"c{i}" for i in range(30)]
    items, rows = [], []
    for i in range(60):
        # what the check lets go is what weighs most
        ends = lambda n: r.sample(rare, n // 5 - 1) + r.choices(common, k=n - 2 * (n // 5) + 2) + r.sample(rare, n // 5 - 1)  # noqa: B023,E731
        q, a = ends(r.choice([20, 30, 45])), ends(r.choice([15, 20, 30]))
        items.append((i, " ".join(q) + "\n" + " ".join(a)))
        far = [f"f{r.randrange(999)}" for _ in range(300)]
        cut = lambda x: x[(len(x) - 4) // 5 :]
        rows.append((3 * i, " ".join(cut(q) + far + cut(a))))
        rows.append((3 * i + 1, " ".join(a + far + q[: len(q) // 2] + far + q[len(q) // 2 :])))
        rows.append((3 * i + 2, " ".join(cut(q) + far)))
    items += [(100, "one two\nthree"), (101, "what is r1\n" + " ".join(rare[:12]))]
    rows += [(900, "three " + "x " * 200 + "one two"), (901, " ".join(rare[:11]) + " y" * 300 + " what is r1"), (902, "one three two")]
    index = D.Index(items)
    found = {(d, index.items[k].item_id): x for (d, _), held in zip(rows, index.search([t for _, t in rows])) for k, x in held.items()}
    want = brute(rows, items)
    assert found.keys() == want and len(want) >= 100 and {(900, 100), (901, 101)} <= want
    assert sum(x[0] < D.THETA for x in found.values()) >= 10
    for (d, i), x in found.items():
        w = [index.ids.get(t, -1) for t in D.words_of(dict(rows)[d])]
        k = next(k for k, y in enumerate(index.items) if y.item_id == i)
        passages = [scores(index, set(w[at : at + 2 * D.UNIT]) - {-1}) for at in range(0, len(w), D.UNIT)]
        assert abs(x[0] - max(p.get(u, 0.0) for p in passages for u, own in enumerate(index.item_of) if own == k)) < 1e-9


def test_scripts_without_spaces(spark):
    """An item inside a longer sentence, in brute force and in the index."""
    r = random.Random(2)
    signs = [chr(c) for c in range(0x4E00, 0x4F00)] + [chr(c) for c in range(0x0E01, 0x0E20)]
    say = lambda n: "".join(r.choices(signs, k=n))
    items = [(i, say(30) if i % 2 else say(25) + "\n" + say(8)) for i in range(20)]
    rows = [(i, say(120) + (text.replace("\n", say(3)) if i % 4 else "") + say(200)) for i, text in items]
    rows += [(100, "前文说明" + items[1][1] + "后文继续"), (101, say(400)), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id for x in D.flag_contaminated(docs, tests).where("contaminated").collect()}
    assert got == {d for d, _ in brute(rows, items)} and 100 in got and 101 not in got and len(got) >= 14
    assert D.words_of("Ab_c 日本x語") == ["ab", "c", "日", "本", "x", "語"]
