"""Vector links against all pairs."""

import numpy as np
import pytest

from beaconflow.llm import embeddings
from beaconflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def fine(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


def brute(rows, cosine=0.9):
    """(n_links, component) of each row; rows are (key, vector)."""
    n, parent = len(rows), list(range(len(rows)))
    units = [np.array(v, float) / np.linalg.norm(v) if fine(v) and k is not None else None for k, v in rows]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return [(k, links[i], None if k is None else low[root(i)]) for i, (k, _) in enumerate(rows)]


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def test_query_covers_every_vector(spark):
    got = QUERIES["op3_embedding_dedup"](spark, SF)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(got) == sorted(brute(rows), key=str)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def clusters(seed=3):
    rng, rows = np.random.default_rng(seed), []
    for c in range(12):
        center = rng.standard_normal(24)
        for spread in (0.05, 0.2, 0.28, 0.33):
            rows += [(0, (center + spread * rng.standard_normal(24)).tolist()) for _ in range(14)]
    rows += [(0, rng.standard_normal(24).tolist()) for _ in range(400)]
    rows += [(0, rows[0][1])] * 40
    return [(7000 - 3 * i, v) for i, (_, v) in enumerate(rows)]


def test_clusters_of_all_widths(spark):
    rows = clusters()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    assert result(got) == sorted(brute(rows), key=str)


def test_close_pairs_inside_a_hot_topic(spark):
    rng = np.random.default_rng(11)
    center = rng.standard_normal(256)
    center /= np.linalg.norm(center)

    def within(n, cosine):  # of vectors in a cone with that cosine between any two
        x = rng.standard_normal((n, 256))
        x -= (x @ center)[:, None] * center
        return np.sqrt(cosine) * center + np.sqrt(1 - cosine) * x / np.linalg.norm(x, axis=1, keepdims=True)

    cone = within(900, 0.8)
    twins = []
    for a, c in zip(cone[:80], np.linspace(0.902, 0.95, 80)):
        z = rng.standard_normal(256)
        z -= (z @ a) * a + ((z @ center) - (z @ a) * (a @ center)) / (1 - (a @ center) ** 2) * (center - (a @ center) * a)
        twins.append(c * a + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    rows = [(5000 - i, v.tolist()) for i, v in enumerate(np.concatenate((cone, twins, rng.standard_normal((1800, 256)))))]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= 0.9, 1)
    assert 75 <= near.sum() <= 90 and near.sum(axis=0).max() == 1 == near.sum(axis=1).max()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), window=8).collect()}
    for i, j in zip(*np.nonzero(near)):
        assert got[5000 - i] == got[5000 - j] == (1, 5000 - j)
    assert sum(n for n, _ in got.values()) == 2 * near.sum()


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = clusters(5)[:300]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert result(got) == sorted(brute(rows), key=str)


def test_odd_vectors(spark):
    v, w = [1.0, 0.0, 0.1], [1e30, 1e28, 1e29]
    rows = [(1, v), (2, v), (None, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]),
            (8, [float("inf"), 0.0, 0.0]), (9, [1.0, 0.0]), (10, [2.0, 0.0]), (11, w), (2, w), (2, v), (12, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, copies int")
    assert result(embeddings.near_duplicates(df)) == sorted(brute(rows), key=str)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [10, 1000, 10 ** 6, 10 ** 9])
def test_passes_grow_slowly(n):
    assert 1 <= embeddings.passes_for(n, 0.9, 64) <= 10 * max(1, n ** 0.25)
