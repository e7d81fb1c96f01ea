"""Links of embeddings against brute force where codes find them least easily."""

import numpy as np
import pytest

pytest.importorskip("vellum.llm.itq_dedup")
from vellum.llm import itq_dedup  # noqa: E402


def planted(pairs, size, shared, seed=5):
    """Vectors of that mean cosine, and for each one a partner at a cosine of 0.95 to 0.96."""
    rnd = np.random.default_rng(seed)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    x = np.sqrt(shared) * np.eye(size)[0] + np.sqrt(1 - shared) * unit(rnd.normal(size=(pairs, size)))
    x = unit(x)
    away = rnd.normal(size=x.shape)
    away = unit(away - (x * away).sum(axis=1, keepdims=True) * x)
    c = rnd.uniform(0.9501, 0.96, (pairs, 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * away])


def recall(spark, x):
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([n for _, n in sorted((r["vec_id"], r["n_links"]) for r in itq_dedup.near_duplicates(frame).collect())])
    want = (x @ x.T >= itq_dedup.COSINE).sum(axis=1) - 1
    assert (got <= want).all()
    return got.sum() / want.sum()


@pytest.mark.parametrize("shared", [0, 0.8, 0.9])
def test_shared_direction(spark, shared):
    found = recall(spark, planted(700, 64, shared))
    print("recall", shared, found)
    assert found >= 0.97


@pytest.mark.parametrize("n", [1 << 18, 1 << 28])
@pytest.mark.parametrize("size", [16, 64])
def test_plan_of_any_size(spark, monkeypatch, n, size):
    width = itq_dedup.plan_width(n)
    monkeypatch.setattr(itq_dedup, "plan_width", lambda m: width)
    found = recall(spark, planted(700, size, 0))
    print("recall", n, size, width, found)
    assert found >= 0.97
