"""The nearest-neighbour search against brute force, where windows are far smaller than
the table."""

import numpy as np
import pytest

from loamgraph.llm import queries
from loamgraph.llm.ann import Curves, hilbert_keys, nearest
from loamgraph.runtime import ship, table


def brute_force(ids, x, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = (ids[order].tolist(), score[order])
    return out


def recall(found, want, k):
    found = found.sort_values(["query_id", "rank"])
    assert set(found["query_id"]) == set(want)
    hit = 0
    for q, rows in found.groupby("query_id"):
        assert rows["rank"].tolist() == list(range(1, len(rows) + 1))
        assert (np.diff(rows["score"]) <= 0).all()
        hit += len(set(want[q][0]) & set(rows["vec_id"]))
    return hit / (k * len(want))


def as_table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("kind, most", [("clustered", 0.1), ("norms", 1.0), ("unstructured", 1.0)])
def test_recall_and_products(spark, kind, most):
    ship(spark)
    rng = np.random.default_rng(3)
    n = 20_000 if kind == "clustered" else 5_000
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = rng.normal(size=(200, 64))[rng.integers(0, 200, n)] + 0.3 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms":
        x *= rng.lognormal(sigma=0.3, size=(n, 1))
        x[7] *= 1000
    x = x.astype(np.float32).astype(np.float64)
    notes = {}
    found = nearest(as_table(spark, x), query_every=100, notes=notes).toPandas()
    assert recall(found, brute_force(np.arange(n), x, 100, 20), 20) >= 0.9
    assert notes["window"] * notes["orderings"] <= most * n or kind != "clustered"


def test_query_on_its_table(spark, sf):
    e = table(spark, sf, "embeddings").toPandas()
    x, ids = np.array(e["embedding"].tolist(), dtype=np.float64), e["vec_id"].to_numpy()
    found = queries.QUERIES["op4_nearest"](spark, sf).toPandas()
    want = brute_force(ids, x, 20, 20)
    assert recall(found, want, 20) >= 0.9
    at = {i: x[ids == i][0] for i in ids.tolist()}
    assert np.allclose(found["score"], [at[q] @ at[v] for q, v in zip(found["query_id"], found["vec_id"])], rtol=0, atol=1e-12)


def test_ties_go_to_the_smaller_ids(spark):
    ship(spark)
    x = np.repeat(np.eye(4), 30, axis=0)
    found = nearest(as_table(spark, x), k=10, query_every=40).toPandas()
    want = brute_force(np.arange(120), x, 40, 10)
    for q, rows in found.sort_values("rank").groupby("query_id"):
        assert rows["vec_id"].tolist() == want[q][0]


def test_hilbert_neighbours_are_next_to_each_other():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    assert Curves().axes * Curves().bits <= 62
