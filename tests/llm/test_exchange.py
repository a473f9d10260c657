"""Co-training: the exchange takes every sure document, equal ones once, and is right as a sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routecraft.llm import cotraining as ct


@pytest.fixture(scope="module")
def two_views(spark):
    rng = np.random.default_rng(3)
    wide_a, wide_b = ct._WIDE
    a, b = rng.normal(size=(300, wide_a)).astype(np.float32), rng.normal(size=(300, wide_b)).astype(np.float32)
    rows = [(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    return a, b, spark.createDataFrame(rows, "a array<float>, b array<float>").repartition(5), rng


def test_exchange_adds_up_all_sure_documents(two_views, monkeypatch):
    a, b, pool, rng = two_views
    own = [(rng.normal(size=(40, v.shape[1])), (np.arange(40) % 3 > 0).astype(float), np.ones(40)) for v in (a, b)]
    teachers = [np.append(rng.normal(size=v.shape[1]), 0.1) for v in (a, b)]
    monkeypatch.setattr(ct, "STEPS", 1)
    got = ct._exchange(pool, own, teachers)
    for view, x in enumerate((a, b)):
        z = ct._logit((b, a)[view], teachers[1 - view])
        x_own, y_own, weight = own[view]
        xs, ys, ws = [x_own], [y_own], [weight]
        for y, sure in ((0.0, z <= -np.log(19)), (1.0, z >= np.log(19))):
            assert sure.sum() > 10
            xs.append(x[sure]), ys.append(np.full(sure.sum(), y)), ws.append(np.full(sure.sum(), (y_own == y).sum() / sure.sum()))
        g, h = ct._sums(np.vstack(xs), np.concatenate(ys), np.concatenate(ws), teachers[view])
        want = teachers[view] + np.linalg.solve(h + ct.RIDGE * np.eye(len(g)), g - ct.RIDGE * teachers[view])
        assert np.allclose(got[view], want, atol=1e-6)


def test_a_view_sure_of_one_class_hands_over_nothing(two_views, monkeypatch):
    a, b, pool, rng = two_views
    own = [(rng.normal(size=(40, v.shape[1])), (np.arange(40) % 3 > 0).astype(float), np.ones(40)) for v in (a, b)]
    good = [np.append(np.zeros(v.shape[1]), 9.0) for v in (a, b)]  # everything is good
    monkeypatch.setattr(ct, "STEPS", 1)
    got = ct._exchange(pool, own, good)
    empty = ct._exchange(pool.limit(0), own, good)
    for view in (0, 1):
        g, h = ct._sums(*own[view], good[view])
        assert np.allclose(got[view], good[view] + np.linalg.solve(h + ct.RIDGE * np.eye(len(g)), g - ct.RIDGE * good[view]))
        assert np.allclose(empty[view], good[view])


def test_copies_do_not_move_the_scores(spark):
    """Thousands of copies of one unlabelled document: the other documents' scores stay."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    one = docs.join(labels.where("quality is not null"), "doc_id", "left_anti").orderBy("doc_id").limit(1)
    if one.isEmpty():  # all are labelled: a text of its own
        one = docs.orderBy("doc_id").limit(1).withColumn("text", F.concat("text", F.lit(" tail")))
    one = one.withColumn("doc_id", F.lit(10**9).cast("long"))
    # half of the labels, so that there is a pool
    half = labels.where(F.col("doc_id") % 2 == 0)
    base = docs.unionByName(one)
    more = base.unionByName(spark.range(2000).select((F.col("id") + 10**9 + 1).alias("doc_id")).crossJoin(one.drop("doc_id")).select(*docs.columns))
    scores = [{r.doc_id: r.score for r in ct.score_documents(t, half).collect()} for t in (base, more)]
    assert len(scores[1]) == len(scores[0]) + 2000
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-6
