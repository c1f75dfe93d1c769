"""The pair scorer against a plain numpy fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionmill.operators import pair_scorer as S


def data(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    cosine, apart, same = rng.uniform(-1, 1, n), rng.exponential(2, n), rng.integers(0, 2, n)
    z = 2 * cosine - 1.2 * apart + 1.5 * same + 0.3
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    return np.stack([cosine, apart, same], 1), y


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, a), int(b), i % 4 == 0) for i, (a, b) in enumerate(zip(x, y))], "cosine double, apart double, same double, label int, held boolean").repartition(5)


NAMES = ["cosine", "apart", "same"]


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_weights_equal_a_plain_fit(spark):
    x, y = data()
    got = S.fit(frame(spark, x, y), NAMES)
    a, w = np.column_stack([np.ones(len(y)), x]), np.zeros(4)
    for _ in range(500):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + S.RIDGE * np.eye(4), a.T @ (p - y) / len(y) + S.RIDGE * w)
    assert np.abs(got - w).max() < 1e-4


def test_held_out_rows_are_ranked_better_than_by_cosine(spark):
    x, y = data()
    df = frame(spark, x, y)
    w = S.fit(df, NAMES, held="held")
    rows = df.where("held").select("label", "cosine", S.probability(w, NAMES).alias("score")).toPandas()
    ours, plain = auc(rows.score.to_numpy(), rows.label.to_numpy()), auc(rows.cosine.to_numpy(), rows.label.to_numpy())
    assert ours > plain + 0.1
    best = S.best_f1_threshold(spark.createDataFrame(rows)).first()
    f1 = lambda t: 2 * ((rows.score >= t) & (rows.label == 1)).sum() / ((rows.score >= t).sum() + rows.label.sum())
    assert best.f1 == pytest.approx(max(f1(t) for t in rows.score)) and best.f1 == pytest.approx(f1(best.threshold))


def test_rare_rows(spark):
    x, y = data(200)
    df = frame(spark, x, y)
    none = F.lit(None).cast("double")
    more = df.unionByName(df.limit(5).withColumn("apart", none)).unionByName(df.limit(5).withColumn("label", F.lit(None).cast("int"))).unionByName(df.limit(5).withColumn("cosine", F.lit(float("nan"))))
    assert np.allclose(S.fit(more, NAMES), S.fit(df, NAMES))
    assert more.where(S.probability(np.ones(4), NAMES).isNull()).count() == 10
    assert S.fit(df.limit(0), NAMES).tolist() == [0.0] * 4 and S.best_f1_threshold(df.limit(0), "apart").count() == 0
    one = S.fit(df.withColumn("label", F.lit(1)), NAMES)
    assert np.isfinite(one).all()


def test_sums_of_tables_equal_sums_of_rows(spark):
    """Rows that are made in tasks need not be written and read for each step, as they were."""
    import pyarrow as pa

    x, y = data(400)
    df = frame(spark, x, y)
    t = pa.Table.from_pandas(df.toPandas())
    parts = [t.slice(0, 150), t.slice(150), t.slice(0, 0)]
    added = lambda w: {c: sum(S.arrow_sums(p, w, NAMES, held="held")[c][0].as_py() for p in parts) for c in S.SUMS(4)}
    w = S.fit_sums(added, 4)
    assert np.allclose(w, S.fit(df, NAMES, held="held"), atol=1e-9)
    counts = pa.concat_tables([S.arrow_counts(p, w, NAMES) for p in parts]).to_pandas()
    got = S.best_f1_of_counts(spark.createDataFrame(counts)).first()
    want = S.best_f1_threshold(df.select("label", F.round(S.probability(w, NAMES), 4).alias("score"))).first()
    assert got == want


def test_query_writes_no_pairs(spark, monkeypatch):
    from mentionmill.plans import registry
    from mentionmill.storage import Scratch

    names, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, **k: (names.append(name), table(self, df, name, **k))[1])
    assert registry.QUERIES["pair_scorer_threshold"](spark, "/root/testdata/sf0.001").count() == 1
    assert names == ["rows"]  # the running sums of the scores
