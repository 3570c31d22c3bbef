"""Regularised boosting against plain NumPy: every split, leaf and margin; what each setting does."""

import numpy as np
import pytest

from beaconflow.plans import boosting as B
from beaconflow.plans.node_table import score_nodes

N, K, FEATURES = 500, 3, ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(N, 3)), 1) + r.integers(0, 9, (N, 3)) * 1e-3 * np.array([1, 2, 3])
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(scale=0.5, size=N) > 0).astype(int) + (x[:, 2] > 0.7)
    w = 1.0 + r.integers(0, 3, N)
    rows = [(i, *map(float, x[i]), int(y[i]), float(w[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, label int, weight double").repartition(2).checkpoint()
    return df, x, y, w


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0)


def worth(g, h, p):
    return soft(g, p["reg_alpha"]) ** 2 / (h + p["reg_lambda"])


def grow(x, g, h, p, depth):
    """(value) or (feature, threshold, left, right): the split of most G^2/H with children of enough weight, then pruned by gain."""
    leaf = (-p["learning_rate"] * soft(g.sum(), p["reg_alpha"]) / (h.sum() + p["reg_lambda"]),)
    best = (1e-9, None, None)
    for f in range(x.shape[1] if depth else 0):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            hl, hr = h[low].sum(), h[~low].sum()
            if min(hl, hr) < p["min_child_weight"]:
                continue
            gain = g[low].sum() ** 2 / hl + g[~low].sum() ** 2 / hr - g.sum() ** 2 / h.sum()
            if gain > best[0] * (1 + 1e-9):
                best = (gain, f, t)
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    left, right = (grow(x[m], g[m], h[m], p, depth - 1) for m in (low, ~low))
    gain = worth(g[low].sum(), h[low].sum(), p) + worth(g[~low].sum(), h[~low].sum(), p) - worth(g.sum(), h.sum(), p)
    return leaf if len(left) == len(right) == 1 and gain < p["gamma"] else (best[1], best[2], left, right)


def value(tree, row):
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def margins(x, y, w, p):
    m = np.zeros((len(y), K))
    for _ in range(p["n_estimators"]):
        e = np.exp(m - m.max(axis=1, keepdims=True))
        q = e / e.sum(axis=1, keepdims=True)
        step = np.zeros_like(m)
        for k in range(K):
            g, h = w * (q[:, k] - (y == k)), w * 2 * np.maximum(q[:, k] * (1 - q[:, k]), B.LEAST_CURVATURE)
            tree = grow(x, g, h, p, p["max_depth"])
            step[:, k] = [value(tree, r) for r in x]
        m += step
    return m


BASE = dict(n_estimators=2, max_depth=2, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0, gamma=0.0, min_child_weight=1.0,
            reg_alpha=0.0, reg_lambda=1.0, seed=1)


def probabilities(model, df):
    return np.array([r.probability for r in sorted(score_nodes(model, df, ["row_id"]).collect(), key=lambda r: r.row_id)])


@pytest.mark.parametrize("change", [{}, {"reg_alpha": 8.0, "reg_lambda": 12.0}, {"gamma": 9.0, "min_child_weight": 40.0, "max_depth": 3, "n_estimators": 1}])
def test_margins_equal_numpy(data, change):
    df, x, y, w = data
    p = BASE | change
    got = probabilities(B.fit_boosted(df, FEATURES, "label", "weight", p, K, parallelism=3), df)
    m = margins(x, y, w, p)
    e = np.exp(m - m.max(axis=1, keepdims=True))
    assert np.abs(got - e / e.sum(axis=1, keepdims=True)).max() < 1e-9


def test_one_leaf_is_the_closed_form(data):
    """A least child weight that no split meets leaves one leaf: -rate * soft(G, alpha) / (H + lambda)."""
    df, _, y, w = data
    p = BASE | {"n_estimators": 1, "min_child_weight": 1e9, "reg_alpha": 5.0, "reg_lambda": 7.0}
    model = B.fit_boosted(df, FEATURES, "label", "weight", p, K)
    for k, r in enumerate(sorted(model.nodes.collect(), key=lambda r: r.tree)):
        g, h = (w * (1 / K - (y == k))).sum(), (w * 2 / K * (1 - 1 / K)).sum()
        assert r.leaf[k] == pytest.approx(-0.3 * soft(g, 5.0) / (h + 7.0), abs=1e-12) and sum(map(bool, r.leaf)) <= 1


def test_samples_rounds_and_odd_rows(data, spark):
    """Row and column samples change the trees, the seed fixes them; a longer fit begins like a shorter one; missing values."""
    df, *_ = data
    p = BASE | {"n_estimators": 1, "subsample": 0.5}
    one, same, other = (probabilities(B.fit_boosted(df, FEATURES, "label", None, p | {"seed": s}, K), df) for s in (1, 1, 2))
    assert np.array_equal(one, same) and not np.array_equal(one, other)
    model = B.fit_boosted(df, FEATURES, "label", None, BASE | {"colsample_bytree": 0.34}, K)
    trees = {}
    for r in model.nodes.collect():
        trees.setdefault(r.tree, set()).update([] if r.feature is None else [r.feature])
    assert len(trees) == 2 * K and all(len(f) <= 2 for f in trees.values())
    short = B.fit_boosted(df, FEATURES, "label", None, BASE | {"colsample_bytree": 0.34, "n_estimators": 1}, K)
    assert np.array_equal(probabilities(B.first_rounds(model, 1), df), probabilities(short, df))
    odd = df.unionByName(spark.createDataFrame([(9001, None, float("nan"), 0.0, 1, 1.0), (9002, 0.0, 0.0, 0.0, None, 1.0)], df.schema))
    assert len(probabilities(B.fit_boosted(odd, FEATURES, "label", "weight", BASE | {"n_estimators": 1}, K), odd)) == N + 2
    with pytest.raises(ValueError):
        B.fit_boosted(df, FEATURES, "label", None, {"depth": 3}, K)


def test_a_leaf_budget_takes_the_splits_of_most_gain(data):
    """At most so many leaves; every tree of the budget is the best of all ways to cut the whole tree down, one gain at a time."""
    df, *_ = data
    p = BASE | {"n_estimators": 1, "max_depth": 5, "min_child_weight": 3.0}
    full = B.fit_boosted(df, FEATURES, "label", "weight", p, K)
    for budget in (2, 4, 7):
        cut = B.fit_boosted(df, FEATURES, "label", "weight", p | {"max_leaves": budget}, K)
        for t in range(K):
            rows = [r for r in cut.nodes.collect() if r.tree == t]
            whole = sum(r.feature is None for r in full.nodes.collect() if r.tree == t)
            assert sum(r.feature is None for r in rows) == min(budget, whole) and whole > 7
    tree = (0, 0.5, (1, 0.5, (0,), (1,)), (2, 0.5, (3, 0.5, (2,), (3,)), (4,)))
    sums = {0: (4.0, 2.0), 1: (-3.0, 2.0), 2: (6.0, 1.0), 3: (-6.5, 1.0), 4: (-1.0, 5.0)}
    reg = {"reg_alpha": 0.0, "reg_lambda": 1.0}
    gain = lambda a, b: B.worth(*a, 0, 1) + B.worth(*b, 0, 1) - B.worth(a[0] + b[0], a[1] + b[1], 0, 1)
    g1, g2, g3 = gain((4, 2), (-3, 2)), gain((-0.5, 2), (-1, 5)), gain((6, 1), (-6.5, 1))
    assert g3 > g1 > 0 > g2  # the largest gain lies behind a split without any
    assert B.largest_leaves(tree, sums, reg | {"max_leaves": 2}) == (0, 0.5, ([0, 1],), ([2, 3, 4],))
    assert B.largest_leaves(tree, sums, reg | {"max_leaves": 9}) == (0, 0.5, (1, 0.5, ([0],), ([1],)), ([2, 3, 4],))


def test_a_search_over_all_nine_parameters(data, spark):
    """History never rises, every parameter varies, and candidates that differ in rounds only share a fit."""
    from unittest.mock import patch

    from beaconflow.plans import search
    from beaconflow.schema import PARAM_NAMES
    df = data[0].selectExpr("*", "case when row_id % 4 = 0 then 'valid' else 'train' end as split")
    bounds = [(1, 2), (0.1, 0.5), (1, 3), (0.6, 1.0), (0.6, 1.0), (0, 2), (1, 5), (0, 5), (0.5, 3)]
    start = [1, 0.3, 2, 0.9, 0.9, 0.0, 1.0, 0.0, 1.0]
    found = search.param_search(df, "label", FEATURES, bounds, start, generations=1, population=4, seed=3)
    history = [r.best_objective for r in found["history"].orderBy("generation").collect()]
    assert len(history) == 2 and history[1] <= history[0] and 0 < found["best_macro_f1"] <= 1
    runs = found["runs"].collect()
    assert len(runs) == 8 and all(len({round(r[n], 6) for r in runs}) > 1 for n in PARAM_NAMES)
    fits = []
    with patch.object(search, "fit_kind", lambda kind, train, f, l, w, p, **k: (fits.append(p["n_estimators"]), (B.fit_boosted(train, f, l, w, p), 0.0))[1]):
        search.param_search(df, "label", FEATURES, [(v, v) if i != 2 else (1, 4) for i, v in enumerate(start)], start, generations=0, population=4, seed=3)
    assert len(fits) == 1


def test_parse_tree():
    text = """DecisionTreeRegressionModel: uid=x, depth=2, numNodes=5, numFeatures=2
  If (feature 1 <= 5.5E-4)
   If (feature 0 <= -3.5)
    Predict: 0.0
   Else (feature 0 > -3.5)
    Predict: 1.0
  Else (feature 1 > 5.5E-4)
   Predict: -1.0E-5
"""
    assert B.parse_tree(text) == (1, 5.5e-4, (0, -3.5, (0,), (1,)), (2,))
    assert B.parse_tree("DecisionTreeRegressionModel: depth=0\n  Predict: 0.5\n") == (0,)
