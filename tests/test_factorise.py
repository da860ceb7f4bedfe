"""Truncated SVD against numpy, and publication of retrained artifacts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rivulet.operators import factorise
from rivulet.operators import recommend as RC
from rivulet.sources import binding as B


def dense(tall, n, k):
    out = np.zeros((n, k))
    for r in tall.collect():
        out[r["id"]] = r["x"]
    return out


@pytest.mark.parametrize("shape, rank, true_rank", [((60, 40), 5, None), ((40, 60), 50, None), ((80, 30), 12, 4), ((1, 7), 3, None)])
def test_svd_equals_numpy(spark, monkeypatch, shape, rank, true_rank):
    monkeypatch.setattr(factorise, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    m, n = shape
    a = rng.normal(size=shape) * (rng.random(shape) < 0.4) if true_rank is None else rng.normal(size=(m, true_rank)) @ rng.normal(size=(true_rank, n))
    a = a @ np.diag(0.8 ** np.arange(n))  # a spectrum that falls
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    left, s, right = factorise.truncated_svd(spark.createDataFrame(cells, "row int, col int, value double").repartition(5), rank)
    want = np.linalg.svd(a, compute_uv=False)
    k = min(rank, int((want > want[0] * 1e-9).sum()))
    assert len(s) == k
    np.testing.assert_allclose(s, want[:k], rtol=2e-2)
    u, v = dense(left, m, k), dense(right, n, k)
    np.testing.assert_allclose(u.T @ u, np.eye(k), atol=1e-8)
    np.testing.assert_allclose(v.T @ v, np.eye(k), atol=1e-8)
    np.testing.assert_allclose(a.T @ u, v * s, atol=1e-8 * s[0])
    best = np.sqrt((want[k:] ** 2).sum())
    assert np.linalg.norm(a - (u * s) @ v.T) <= best * 1.05 + 1e-8 * s[0]


def test_svd_of_nothing(spark):
    _, s, right = factorise.truncated_svd(spark.createDataFrame([(0, 0, 0.0), (1, 2, None)], "row int, col int, value double"), 3)
    assert len(s) == 0 and right.count() == 0


def test_a_failed_retrain_leaves_the_old_version(spark, tmpdir_path, monkeypatch):
    inter, users, items = B.interactions(spark, SF_SMALL), B.users(spark, SF_SMALL), B.items(spark, SF_SMALL)
    small = dict(max_iter=2, max_depth=2)
    with pytest.raises(FileNotFoundError):
        RC.load_artifacts(spark, tmpdir_path)
    first = RC.retrain(spark, inter, users, items, B.as_of(inter), 42, tmpdir_path, **small)
    assert first["version"] == 0 and first["factors"].kind == "svd"
    before = first["covisitation"].count()
    assert before and first["training_set"].count() and first["vectors"].count() and first["profiles"]["profile"].count()
    half = inter.sample(0.5, 3)

    def fails(*args, **kw):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(RC, "fit_factors", fails)
        with pytest.raises(RuntimeError):
            RC.retrain(spark, half, users, items, B.as_of(inter), 42, tmpdir_path, **small)
    still = RC.load_artifacts(spark, tmpdir_path)
    assert still["version"] == 0 and still["covisitation"].count() == before
    second = RC.retrain(spark, half, users, items, B.as_of(inter), 42, tmpdir_path, **small)
    assert second["version"] == 1 and second["covisitation"].count() < before
    pairs = inter.select("user_id", "item_id").distinct()
    assert RC.factor_scores(pairs, second["factors"]).agg(F.max("factor_score")).first()[0] <= 1.0


def test_gram_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=(50, 6))
    tall = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, x array<double>").repartition(4)
    np.testing.assert_allclose(factorise.gram(tall, 6), x.T @ x, atol=1e-12)


def test_factors_are_fitted_without_a_ranker(spark, monkeypatch):
    from rivulet.plans import q_recommend as Q
    rows = [(f"u{u}", f"i{i}", "view", 10 * u + i, 3.0) for u in range(6) for i in range(5) if (u + i) % 3]
    inter = spark.createDataFrame(rows, "user_id string, item_id string, interaction_type string, dwell_seconds int, rating double")
    monkeypatch.setattr(Q.B, "interactions", lambda spark, sf: inter)
    monkeypatch.setattr(Q.RC, "fit_ranker", lambda *a, **k: pytest.fail("trained a ranker"))
    monkeypatch.setattr(Q, "_MODELS", {})
    got = {r["item"]: r["rank"] for r in Q.fit_factors_q(spark, "own").collect()}
    assert set(got) == {f"i{i}" for i in range(5)} and len(set(got.values())) == 1


def test_svd_in_blocks_leaves_its_result_alone(spark, monkeypatch):
    """Products in several blocks and passes, of repeated and missing ids; of
    the tables on the way none is kept."""
    import os

    from rivulet.session import checkpoint_dir
    monkeypatch.setattr(factorise, "BLOCK_BYTES", 10 * 8 * 14)
    monkeypatch.setattr(factorise, "ENTRIES", 7)
    rng = np.random.default_rng(8)
    a = np.round(rng.normal(size=(45, 30)) * (rng.random((45, 30)) < 0.3) @ np.diag(0.8 ** np.arange(30)), 3)
    a[7], a[:, 3] = 0, 0
    cells = [(int(i), int(j), float(a[i, j]) / 2) for i, j in zip(*np.nonzero(a))] * 2
    folder = checkpoint_dir(spark).removeprefix("file:") + "/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    left, s, right = factorise.truncated_svd(spark.createDataFrame(cells, "row int, col int, value double").repartition(3), 4)
    u, v = dense(left, 45, 4), dense(right, 30, 4)
    np.testing.assert_allclose(s, np.linalg.svd(a, compute_uv=False)[:4], rtol=2e-2)
    np.testing.assert_allclose(a.T @ u, v * s, atol=1e-8 * s[0])
    np.testing.assert_allclose(u.T @ u, np.eye(4), atol=1e-8)
    assert {r["id"] for r in left.collect()} == set(range(45)) - {7} and left.count() == 44
    left_over = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left_over == {"left", "right"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
