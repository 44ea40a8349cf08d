import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import exact_dedup as E
from folioforge.llm.common import materialize
from folioforge.llm.exact_dedup import digest_runs, drop_exact_copies, exact_dedup, levels


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        cp, _, keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, keep, len(groups[norm]), i == keep and len(t or "") == -cp, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choices("ab \t é", k=r.randrange(5)))) for i in range(400)]
    rows += [(None, "ab"), (None, None), (7, "a b"), (7, "a b"), (500, "z" * 200_000), (501, "z " * 100_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, digest string").repartition(7)
    got = sorted((tuple(x) for x in exact_dedup(df).collect()), key=repr)
    assert got == brute(rows)


def test_hot_group_and_empty(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text")
    got = exact_dedup(df).where("not kept").collect()
    assert len(got) == 999 and {x.keep_id for x in got} == {0} and {x.group_size for x in got} == {1000}
    assert drop_exact_copies(df).count() == 2001
    assert exact_dedup(df.limit(0)).count() == 0


def test_repeated_identifiers_lose_no_text(spark):
    rows = [(3, "same"), (5, "s ame"), (5, "a quite unique other text"), (7, "twin"), (7, "twin"), (8, "b c"), (8, "bc "), (None, "bc"), (None, "alone"), (None, "alone"), (9, None), (9, "")]
    df = spark.createDataFrame([(*x, "c", n) for n, x in enumerate(rows)], "doc_id long, text string, k1 string, __0 int").repartition(4)
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    left = sorted(((x.doc_id, x.text) for x in got.collect()), key=repr)
    # 5 has the longer copy of same; of the equal rows of 7, 9 and null one stays
    assert [x for x in left if x[0] not in (8, 9)] == sorted([(5, "a quite unique other text"), (5, "s ame"), (7, "twin"), (None, "alone")], key=repr)
    assert len([x for x in left if x[0] == 8]) == 1 and len([x for x in left if x[0] == 9]) == 1


def test_rows_against_brute_force(spark):
    r = random.Random(8)
    rows = [(r.choice([None, *range(12)]), "".join(r.choices("ab ", k=r.randrange(4)))) for _ in range(300)]
    left = sorted(((x.doc_id, x.text) for x in drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()), key=repr)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.replace(" ", "")].append((-len(t), i is None, i or 0))
    assert sorted((t.replace(" ", ""), -len(t), i is None, i or 0) for i, t in left) == sorted((k, *min(v)) for k, v in groups.items())


def test_slots_are_partitions_of_sorted_runs(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "concat('t', id % 1700, if(id % 5 = 0, '', '  ')) as text").repartition(11)
    runs = materialize(digest_runs(df), "test-runs").repartition(11)
    *inner, last = levels(runs, bits=2)
    assert len(inner) == 2
    for low, level in zip((2, 4), inner):
        rows = level.select("slot", F.spark_partition_id().alias("at"), "digest", "size").collect()
        assert sum(x["size"] for x in rows) == 5000
        for x in rows:
            assert x["slot"] == x["at"] and (int.from_bytes(x["digest"][:4], "big") ^ x["slot"]) % (1 << low) == 0
    rows = last.select("slot", F.spark_partition_id().alias("at"), "digest", "size").collect()
    assert len(rows) == len({bytes(x["digest"]) for x in rows}) == 1700 and len({x["at"] for x in rows}) == 16
    for at in range(16):
        own = [bytes(x["digest"]) for x in rows if x["at"] == at]
        assert own == sorted(own)
    # nothing but the rounds moves entries
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "HashAggregate" not in plan


def test_wrong_slots_and_orders_stop_the_job():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(4)]
    names = [f.split()[0] for f in E.ENTRY.split(", ")]

    def run(order, slot, low):
        n = len(order)
        cols = [pa.array([slot] * n, pa.int32()), pa.array([digests[i] for i in order], pa.binary()), *([pa.array([1] * n, pa.int64())] * 3), pa.array([False] * n), *([pa.array([1] * n, pa.int64())] * 4)]
        return list(E._collapse(low, low + 1)(iter([pa.RecordBatch.from_arrays(cols, names)])))

    order = sorted(range(4), key=lambda i: digests[i])
    assert sum(b.num_rows for b in run(order, 0, 0)) == 4
    with pytest.raises(RuntimeError, match="ascend"):
        run(order[::-1], 0, 0)
    with pytest.raises(RuntimeError, match="slot"):
        run(order, 0, 8)
