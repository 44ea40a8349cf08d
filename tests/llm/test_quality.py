import duckdb
import numpy as np

from folioforge.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = Q.train(docs, seen)
    got = Q.score(docs.join(unseen.select("doc_id"), "doc_id", "left_semi"), model).toPandas().merge(Q.graded(unseen).toPandas(), on="doc_id")
    share = got.groupby("grade").selected.mean()
    assert share[2] > 0.98 and share[0] < 0.05 and share[1] < 0.12
    mean = got.groupby("grade").expected_grade.mean()
    assert mean[0] < mean[1] < mean[2]


def test_fit_recovers_ordered_thresholds():
    r = np.random.default_rng(3)
    n, weight = 4000, np.array([2.5, -2.0, 0.0, 1.5])
    x = r.random((n, 4)) < 0.4
    y = ((x @ weight + r.logistic(size=n))[:, None] > np.array([-1.0, 1.5])).sum(1)
    m = Q.fit([np.flatnonzero(row).astype(np.int32) for row in x], y, 3, 600, 0.05, 0.01)
    assert np.allclose(m.weights[:4], weight, atol=0.25) and np.allclose(m.thresholds, [-1.0, 1.5], atol=0.25)


def test_cases(spark):
    rows = [(i, "good words of prose here" if i % 2 else "stupid!!! BAD*** trash&&&", "x") for i in range(400)] + [(None, None, "x"), (7, "", None), (7, "", None), (1000, "word " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, selected string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(300)] + [(1, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels, sample=200)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    assert all(got[i].selected == bool(i % 2) for i in range(300, 400))
    kept = Q.select_good(docs, model)
    assert kept.columns == docs.columns and Q.score(docs, model).where("selected").count() == kept.count()
    assert Q.score(docs.limit(0), model).count() == 0
    none = Q.train(docs, labels.limit(0))
    assert Q.select_good(docs, none).count() == len(rows)


def test_whole_table_is_scored(spark):
    n = duckdb.sql("select count(*) from '/root/testdata/sf0.01/documents.parquet'").fetchall()[0][0]
    from folioforge.llm.queries import op9_ordinal_quality

    assert op9_ordinal_quality(spark, "/root/testdata/sf0.01").count() == n


def test_fit_against_brute_force():
    """No point of a fine search around it has a better penalised likelihood."""
    r = np.random.default_rng(5)
    n, ridge = 240, 0.3
    x = r.random((n, 3)) < 0.5
    y = ((x @ np.array([3.0, -2.0, 1.0]) + r.logistic(size=n))[:, None] > np.array([-0.5, 1.0])).sum(1)
    Q_chi2, Q.CHI2 = Q.CHI2, 0.0
    try:
        m = Q.fit([np.flatnonzero(row).astype(np.int32) for row in x], y, 3, 1500, 0.03, ridge)
    finally:
        Q.CHI2 = Q_chi2

    def loss(p):
        w, cuts = p[:3], np.sort(p[3:])
        at = lambda k: np.where(k == 0, 0.0, np.where(k == 3, 1.0, 1 / (1 + np.exp(-(cuts[np.clip(k - 1, 0, 1)] - x @ w)))))
        return -np.log(np.maximum(at(y + 1) - at(y), 1e-12)).sum() + ridge / 2 * (w**2).sum()

    best = np.concatenate([m.weights[:3], m.thresholds])
    least = loss(best)
    p, step = r.normal(size=5), 1.0
    while step > 1e-4:  # a plain pattern search from elsewhere
        for d in np.vstack([np.eye(5), -np.eye(5)]):
            if loss(p + step * d) < loss(p):
                p = p + step * d
                break
        else:
            step /= 2
    p[3:].sort()
    assert abs(loss(p) - least) < 1e-2 and np.allclose(p, best, atol=0.05)


def test_scores_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "some good words"), (2, "BAD *** words"), (3, None), (4, "")], "doc_id long, text string")
    w = np.zeros(Q.SLOTS)
    w[Q.features("good")] = 1.5
    model = Q.Ordinal(w, np.array([-1.0, 0.5]))
    for row in Q.score(docs, model).collect():
        text = {1: "some good words", 2: "BAD *** words"}.get(row.doc_id)
        s = sum(w[i] for i in set(Q.features(text).tolist()))
        above = [1 - 1 / (1 + np.exp(-(c - s))) for c in (-1.0, 0.5)]
        assert abs(row.expected_grade - sum(above)) < 1e-5 and abs(row.p_top - above[1]) < 1e-5 and row.selected == (round(above[1], 6) >= 0.5)


def test_scripts_without_spaces_have_features():
    from folioforge.llm.quality import features

    a, b = features("前文说明后文继续"), features("前文说明")
    assert len(b) > 8 and set(b.tolist()) - set(a.tolist()) != set(b.tolist())
    assert features("plain words, here").tolist() == features("plain words, here").tolist()
