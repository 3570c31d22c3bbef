"""M1: multiclass gradient boosting with the regularisation of the reference's model.

Each round fits one of Spark's regression trees for every class to the Newton step -g/h of the softmax loss, rows weighted by
their curvature h, so that Spark's variance split is the split of largest G^2/H.  Leaves are then valued again from one
aggregate of gradients and curvatures: splits whose regularised gain is below ``gamma`` are taken back from the
bottom up, and a leaf is worth -rate * soft(G, reg_alpha) / (H + reg_lambda).  The model is a node table of margins.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import sys
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .node_table import NodeModel, node_table

#: The nine parameters and the seed, with the reference's final settings; the last four are its learner's own defaults.
SETTINGS = dict(n_estimators=501, max_depth=8, learning_rate=0.068, subsample=0.92, colsample_bytree=0.80, seed=42,
                gamma=0.0, min_child_weight=1.0, reg_alpha=0.0, reg_lambda=1.0, max_leaves=None)
#: p (1 - p) never counts as less; rounds between reliable checkpoints; histogram bins of a feature.
LEAST_CURVATURE, CHECKPOINT_EVERY, BINS = 1e-6, 10, 256
LARGEST = sys.float_info.max


def parse_tree(text: str) -> tuple:
    """A tree from Spark's description: (feature, threshold, left, right), or (leaf number,) in order from the left."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]
    at, leaves = 0, 0

    def read() -> tuple:
        nonlocal at, leaves
        line, at = lines[at], at + 1
        if line.startswith("Predict"):
            leaves += 1
            return (leaves - 1,)
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = read()
        at += 1  # Else
        return (int(feature), float(threshold), left, read())

    return read()


def soft(g: float, alpha: float) -> float:
    return math.copysign(max(abs(g) - alpha, 0.0), g)


def worth(g: float, h: float, alpha: float, lam: float) -> float:
    """What a leaf takes off the loss (twice): soft(G)^2 / (H + lambda)."""
    return soft(g, alpha) ** 2 / (h + lam) if h + lam > 0 else 0.0


def largest_leaves(tree: tuple, sums: dict[int, tuple[float, float]], p: dict) -> tuple:
    """The tree cut to at most ``max_leaves`` leaves: from the root, the split of most gain is taken first, and so on.

    A node that is not split any more becomes (leaf numbers,) of all below it.  Splits without gain are not taken.  Since a
    node's own split does not depend on when it is taken, this is the tree that leaf-wise growth gives.
    """
    reg, count = (p["reg_alpha"], p["reg_lambda"]), itertools.count()

    def weigh(t: tuple) -> dict:
        if len(t) == 1:
            g, h = sums.get(t[0], (0.0, 0.0))
            return {"g": g, "h": h, "numbers": [t[0]], "split": None}
        left, right = weigh(t[2]), weigh(t[3])
        n = {"g": left["g"] + right["g"], "h": left["h"] + right["h"], "numbers": left["numbers"] + right["numbers"], "taken": False}
        gain = worth(left["g"], left["h"], *reg) + worth(right["g"], right["h"], *reg) - worth(n["g"], n["h"], *reg)
        return n | {"split": (t[0], t[1], left, right), "gain": gain}

    root = weigh(tree)
    open_ = [(-root["gain"], next(count), root)] if root["split"] else []
    leaves = 1
    while open_ and leaves < p["max_leaves"]:
        gain, _, n = heapq.heappop(open_)
        if gain >= 0:
            break
        n["taken"], leaves = True, leaves + 1
        for child in n["split"][2:]:
            if child["split"]:
                heapq.heappush(open_, (-child["gain"], next(count), child))

    def cut(n: dict) -> tuple:
        if n["split"] and n["taken"]:
            return (*n["split"][:2], cut(n["split"][2]), cut(n["split"][3]))
        return (n["numbers"],)

    return cut(root)


def prune(tree: tuple, sums: dict[int, tuple[float, float]], p: dict) -> tuple[tuple, float, float]:
    """The tree with the values of its leaves, (value, leaf numbers) each, and its gradient and curvature.

    A split of two leaves goes when their worth exceeds that of their parent by less than ``gamma``; then its parent
    may go too.  A leaf of ``tree`` is one leaf number or a list of several.
    """
    def leaf(g: float, h: float, numbers: list[int]) -> tuple:
        w = -p["learning_rate"] * soft(g, p["reg_alpha"]) / (h + p["reg_lambda"]) if h + p["reg_lambda"] > 0 else 0.0
        return (w, numbers)

    if len(tree) == 1:
        numbers = tree[0] if isinstance(tree[0], list) else [tree[0]]
        g, h = (sum(sums.get(i, (0.0, 0.0))[j] for i in numbers) for j in (0, 1))
        return leaf(g, h, numbers), g, h
    (left, gl, hl), (right, gr, hr) = prune(tree[2], sums, p), prune(tree[3], sums, p)
    g, h = gl + gr, hl + hr
    reg = p["reg_alpha"], p["reg_lambda"]
    if len(left) == len(right) == 2 and worth(gl, hl, *reg) + worth(gr, hr, *reg) - worth(g, h, *reg) < p["gamma"]:
        return leaf(g, h, left[1] + right[1]), g, h
    return (tree[0], tree[1], left, right), g, h


def leaf_values(tree: tuple) -> dict[int, float]:
    return {n: tree[0] for n in tree[1]} if len(tree) == 2 else leaf_values(tree[2]) | leaf_values(tree[3])


def node_rows(tree: tuple, number: int, klass: int, n_classes: int, columns: list[int]) -> list[tuple]:
    """Rows of the node table; ``columns`` are the places of the tree's features among all."""
    rows: list[tuple] = []

    def walk(t: tuple) -> int:
        me = len(rows)
        rows.append(())
        if len(t) == 2:
            rows[me] = (number, me, None, None, None, None, [t[0] if k == klass else 0.0 for k in range(n_classes)])
        else:
            left, right = walk(t[2]), walk(t[3])
            rows[me] = (number, me, columns[t[0]], t[1], left, right, None)
        return me

    walk(tree)
    return rows


def _with_steps(df: DataFrame, n_classes: int) -> DataFrame:
    """Adds ``_g`` and ``_h``: gradient and curvature of every class at the margins ``_m``."""
    df = df.withColumn("_e", F.transform("_m", lambda m: F.exp(m - F.array_max("_m"))))
    df = df.withColumn("_p", F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
    g = F.transform("_p", lambda p, k: F.col("_w") * (p - (F.col("_y") == k).cast("double")))
    h = F.transform("_p", lambda p: F.col("_w") * 2.0 * F.greatest(p * (1.0 - p), F.lit(LEAST_CURVATURE)))
    return df.select("_y", "_w", "_k", "_x", "_m", g.alias("_g"), h.alias("_h"))


def fit_boosted(df: DataFrame, features: list[str], label: str, weight: str | None = None, params: dict | None = None,
                n_classes: int = 6, key: str | None = "row_id", parallelism: int = 6) -> NodeModel:
    """A softmax model of ``n_estimators`` rounds with one tree for each class and round (SETTINGS; all nine act).

    ``max_depth``: levels below a root; ``learning_rate`` scales leaves; ``subsample``: share of rows that a round's trees
    see (by hash of ``key``, or of the whole row without one); ``colsample_bytree``: share of features that a tree sees;
    ``min_child_weight``: least sum of curvatures in a child; ``gamma``: least gain (soft(G)^2 / (H + reg_lambda) of the
    children less that of the parent) of a split that stays; ``reg_alpha`` and ``reg_lambda``: see the module;
    ``max_leaves``: at most so many leaves a tree, those of most gain (``largest_leaves``; None: no bound).  Rows without
    a label are left out; missing features go right.  Margins start at 0; g = w (p - y), h = 2 w p (1 - p).

    Rows keep their margins in a persisted frame, checkpointed every CHECKPOINT_EVERY rounds; trees of a round are
    fitted side by side; only leaf sums (at most 2^max_depth for each class) reach the driver.
    """
    if unknown := sorted(set(params or {}) - set(SETTINGS)):
        raise ValueError(f"a boosted model has no settings {unknown}")
    p = SETTINGS | (params or {})
    p["max_depth"], p["n_estimators"], seed = int(p["max_depth"]), int(p["n_estimators"]), int(p["seed"])
    spark, classes = df.sparkSession, range(n_classes)
    ensure_checkpoint_dir(spark)
    of_row = F.xxhash64(key) if key and key in df.columns else F.xxhash64(*features, label)
    # Spark's trees take finite numbers only: missing ones are larger than any threshold
    finite = {f"_x{i}": F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(LARGEST)), F.lit(LARGEST))))
              for i, c in enumerate(features)}
    x = VectorAssembler(inputCols=list(finite), outputCol="_x").transform(df.where(F.col(label).isNotNull()).withColumns(finite))
    frame = x.select(F.col(label).cast("int").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
                     of_row.alias("_k"), "_x", F.array(*[F.lit(0.0)] * n_classes).alias("_m"))
    frame = _with_steps(frame, n_classes).persist(StorageLevel.MEMORY_AND_DISK)
    some = max(1, math.ceil(p["colsample_bytree"] * len(features) - 1e-9))
    draw, rows = np.random.default_rng(seed), []

    for r in range(p["n_estimators"]):
        seen = frame
        if p["subsample"] < 1:
            share = F.pmod(F.xxhash64("_k", F.lit(seed), F.lit(r)), F.lit(1 << 30)) < int(p["subsample"] * (1 << 30))
            seen = seen.where(share)
        total = seen.agg(*[F.sum(F.col("_h")[k]).alias(f"h{k}") for k in classes]).first()
        columns = [sorted(draw.choice(len(features), some, replace=False).tolist()) for _ in classes]

        def tree_of(k: int) -> DecisionTreeRegressionModel | None:
            if not total[k] or 2 * p["min_child_weight"] > total[k]:
                return None  # no split leaves both children enough
            part = sliced(seen, columns[k]).select("_f", (-F.col("_g")[k] / F.col("_h")[k]).alias("_t"), F.col("_h")[k].alias("_c"))
            return DecisionTreeRegressor(featuresCol="_f", labelCol="_t", weightCol="_c", maxDepth=p["max_depth"], maxBins=BINS,
                                         minWeightFractionPerNode=min(p["min_child_weight"] / total[k], 0.499999), seed=seed + r,
                                         cacheNodeIds=False, maxMemoryInMB=1024).fit(part)

        def sliced(d: DataFrame, chosen: list[int]) -> DataFrame:
            if len(chosen) == len(features):
                return d.withColumn("_f", F.col("_x"))
            return VectorSlicer(inputCol="_x", outputCol="_f", indices=chosen).transform(d)

        def with_leaves(d: DataFrame) -> DataFrame:
            for k in classes:
                if trees[k] is None:
                    d = d.withColumn(f"_leaf{k}", F.lit(0))
                    continue
                m = trees[k].copy().setFeaturesCol("_f").setLeafCol("_l").setPredictionCol("_q")
                d = m.transform(sliced(d, columns[k])).withColumn(f"_leaf{k}", F.col("_l").cast("int")).drop("_f", "_l", "_q")
            return d

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            trees = list(ex.map(tree_of, classes))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_leaf{k}").alias("leaf"), F.col("_g")[k].alias("g"), F.col("_h")[k].alias("h"))
                                   for k in classes])).alias("e")
        sums = with_leaves(seen).select(each).groupBy("e.k", "e.leaf").agg(F.sum("e.g").alias("g"), F.sum("e.h").alias("h")).collect()
        margins = []
        for k in classes:
            tree = parse_tree(trees[k].toDebugString) if trees[k] is not None else (0,)
            mine = {s["leaf"]: (s["g"], s["h"]) for s in sums if s["k"] == k}
            if p["max_leaves"]:
                tree = largest_leaves(tree, mine, p)
            cut, _, _ = prune(tree, mine, p)
            values = leaf_values(cut)
            rows += node_rows(cut, r * n_classes + k, k, n_classes, columns[k])
            by_leaf = F.array(*[F.lit(float(values[i])) for i in range(len(values))])
            margins.append(F.get("_m", F.lit(k)) + F.get(by_leaf, F.col(f"_leaf{k}")))
        done = _with_steps(with_leaves(frame).select("_y", "_w", "_k", "_x", F.array(*margins).alias("_m")), n_classes)
        done = done.checkpoint(eager=True) if (r + 1) % CHECKPOINT_EVERY == 0 else done.persist(StorageLevel.MEMORY_AND_DISK)
        done.count()
        frame.unpersist()
        frame = done
    frame.unpersist()
    return node_table(spark, rows, features, n_classes, "softmax")


def first_rounds(model: NodeModel, rounds: int) -> NodeModel:
    """The model as it stood after ``rounds`` rounds: a longer fit holds every shorter one of the same settings."""
    return NodeModel(model.nodes.where(F.col("tree") < rounds * model.n_classes), model.features, model.n_classes, model.link)
