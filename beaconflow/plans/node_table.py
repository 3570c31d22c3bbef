"""Tree models as a relation: one row for each node, scored by joins and aggregates.

A table of nodes can be stored, queried, joined and committed like any other; ``export_nodes`` makes one of a fitted
pipeline, ``plans.boosting`` builds its models as one.  A node's row says which feature is compared with which
threshold ((x - shift) * scale <= threshold goes left, anything else and missing values go right) and where that leads; a
leaf leads to itself and carries a vector of ``n_classes`` numbers.  A row's score is the sum of its leaves' vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

NODE_SCHEMA = ("tree int, node int, depth int, feature int, threshold double, shift double, scale double, "
               "left int, right int, leaf array<double>")
#: Nodes of a table that may be broadcast (about 100 bytes each); larger ones are joined by shuffling.
BROADCAST_NODES = 500_000


@dataclass
class NodeModel:
    """``nodes`` (NODE_SCHEMA; trees 0, 1, ... with root 0), the features that they number, and how scores become probabilities.

    ``link``: "share" (scores are votes) or "softmax" (scores are margins).
    """

    nodes: DataFrame
    features: list[str]
    n_classes: int
    link: str = "share"

    def size(self) -> tuple[int, int, int]:
        """Trees, the deepest level and nodes of the table."""
        r = self.nodes.agg(F.max("tree"), F.max("depth"), F.count(F.lit(1))).first()
        return (r[0] if r[0] is not None else -1) + 1, r[1] or 0, r[2]


def export_nodes(model: PipelineModel) -> NodeModel:
    """The node table of a fitted assembler -> scaler -> decision tree or forest pipeline.

    Spark saves a tree model as a table of its nodes; that table is read back, thresholds stay those of the scaled
    features (with the scaler's shift and scale beside them, so that scoring compares the same numbers), and a leaf's
    vector is its share of each class.
    """
    asm, scaler, clf = model.stages
    spark = SparkSession.getActiveSession()
    path = scratch_dir(spark, "nodes")
    clf.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" not in saved.columns:  # a single tree
        saved = saved.select(F.lit(0).alias("treeID"), F.struct(*saved.columns).alias("nodeData"))
    n = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    mean = scaler.mean.toArray().tolist() if scaler.getWithMean() else [0.0] * len(asm.getInputCols())
    std = scaler.std.toArray().tolist()
    scale = [1.0 / s if s != 0 else 0.0 for s in std] if scaler.getWithStd() else [1.0] * len(mean)
    inner = F.col("leftChild") >= 0
    f = F.when(inner, F.col("split.featureIndex"))
    place = F.greatest(f, F.lit(0))
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    flat = n.select(
        "tree", F.col("id").alias("node"), f.alias("feature"), F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.get(F.array(*map(F.lit, mean)), place)).alias("shift"), F.when(inner, F.get(F.array(*map(F.lit, scale)), place)).alias("scale"),
        F.when(inner, F.col("leftChild")).otherwise(F.col("id")).alias("left"), F.when(inner, F.col("rightChild")).otherwise(F.col("id")).alias("right"),
        F.when(~inner, F.transform("impurityStats", lambda v: v / total)).alias("leaf"))
    return NodeModel(with_depth(flat), list(asm.getInputCols()), clf.numClasses, "share")


def with_depth(nodes: DataFrame) -> DataFrame:
    """The table with each node's level, walked down from the roots: one join for each level of the model."""
    nodes = nodes.checkpoint(eager=True)
    level = nodes.where("node = 0").select("tree", "node", "left", "right").withColumn("depth", F.lit(0))
    seen, edge = level, nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("left").alias("_l"), F.col("right").alias("_r"))
    while True:
        down = level.where("left <> node").select("tree", F.explode(F.array("left", "right")).alias("node"), (F.col("depth") + 1).alias("depth"))
        level = down.join(edge, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n"))).select(
            "tree", "node", F.col("_l").alias("left"), F.col("_r").alias("right"), "depth").checkpoint(eager=True)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    names = [c.strip().split(" ")[0] for c in NODE_SCHEMA.split(",")]
    return nodes.join(seen.select("tree", "node", "depth"), ["tree", "node"]).select(*names).checkpoint(eager=True)


def node_table(spark: SparkSession, rows: list[tuple], features: list[str], n_classes: int, link: str = "share") -> NodeModel:
    """A model of (tree, node, feature, threshold, left, right, leaf) rows; leaves have a vector and no feature."""
    full = [(t, n, f, thr, 0.0 if f is not None else None, 1.0 if f is not None else None, n if f is None else l, n if f is None else r, leaf)
            for t, n, f, thr, l, r, leaf in rows]
    schema = ", ".join(c for c in NODE_SCHEMA.split(", ") if not c.startswith("depth"))
    return NodeModel(with_depth(spark.createDataFrame(full, schema)), features, n_classes, link)


def _with_probability(df: DataFrame, scores: Column, link: str) -> DataFrame:
    """Adds ``probability`` to a frame whose rows have the array ``scores`` of summed leaf vectors."""
    df = df.withColumn("_v", scores)
    if link == "softmax":
        df = df.withColumn("_v", F.transform("_v", lambda s: F.exp(s - F.array_max("_v"))))
    return df.withColumn("probability", F.transform("_v", lambda s: s / F.aggregate("_v", F.lit(0.0), lambda a, b: a + b)))


def _with_class(df: DataFrame, keep: list[str]) -> DataFrame:
    first = F.array_position("probability", F.array_max("probability")) - 1  # the first of equal ones, as Spark ML
    return df.select(*keep, first.cast("int").alias("prediction"), "probability")


def score_nodes(model: NodeModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``prediction`` and ``probability`` of every row: a join for each level, then one sum.

    Every row starts at the root of every tree; a join with the node table takes it one level down.  The table is broadcast if
    it has at most BROADCAST_NODES rows and shuffled by (tree, node) otherwise.  Leaf vectors are summed by row (partly
    before the shuffle); equal rows are counted and come back as often as they came.
    """
    if df.isStreaming:
        return score_rows(model, df, keep)
    trees, levels, n = model.size()
    nodes = model.nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "feature", "threshold", "shift", "scale", "left", "right", "leaf")
    nodes = F.broadcast(nodes) if n <= BROADCAST_NODES else nodes
    at = (F.col("_tree") == F.col("_t")) & (F.col("_node") == F.col("_n"))
    own = [f"_k{i}" for i in range(len(keep))]
    x = df.select(*[F.col(c).alias(o) for c, o in zip(keep, own)], F.array(*[F.col(c).cast("double") for c in model.features]).alias("_x"))
    x = x.withColumn("_h", F.xxhash64("_x")).withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_node", F.lit(0))
    for _ in range(levels):
        go = (F.get("_x", F.col("feature")) - F.col("shift")) * F.col("scale") <= F.col("threshold")
        x = x.join(nodes, at).select(*own, "_x", "_h", "_tree", F.when(go, F.col("left")).otherwise(F.col("right")).alias("_node"))
    x = x.join(nodes, at).select(*own, "_h", *[F.get("leaf", F.lit(k)).alias(f"_s{k}") for k in range(model.n_classes)])
    sums = x.groupBy(*own, "_h").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s{k}").alias(f"_s{k}") for k in range(model.n_classes)])
    times = (F.col("_n") / trees).cast("int")
    sums = sums.withColumn("_i", F.explode(F.sequence(F.lit(1), times)))
    out = sums.select(*[F.col(o).alias(c) for o, c in zip(own, keep)], F.array(*[F.col(f"_s{k}") / times for k in range(model.n_classes)]).alias("_sum"))
    return _with_class(_with_probability(out, F.col("_sum"), model.link), keep)


def score_rows(model: NodeModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """The same row by row, without a shuffle (for streams): the nodes lie in arrays of one broadcast row.

    The model is gathered into that row, so it is bounded by BROADCAST_NODES.
    """
    trees, levels, n = model.size()
    if n > BROADCAST_NODES:
        raise ValueError(f"{n} nodes are too many for one row; score in batches")
    spark = df.sparkSession
    table = sorted(model.nodes.collect(), key=lambda r: (r["tree"], r["node"]))
    place = {(r["tree"], r["node"]): i for i, r in enumerate(table)}
    packed = spark.createDataFrame([(
        [place[t, 0] for t in range(trees)], [r["feature"] if r["feature"] is not None else 0 for r in table],
        [r["threshold"] if r["threshold"] is not None else 0.0 for r in table], [r["shift"] or 0.0 for r in table],
        [r["scale"] if r["scale"] is not None else 0.0 for r in table], [place[r["tree"], r["left"]] for r in table],
        [place[r["tree"], r["right"]] for r in table], [r["leaf"] for r in table])],
        "_roots array<int>, _f array<int>, _t array<double>, _m array<double>, _s array<double>, _l array<int>, _r array<int>, _leaf array<array<double>>")
    x = df.select(*keep, F.array(*[F.col(c).cast("double") for c in model.features]).alias("_x")).join(F.broadcast(packed))

    def down(node: Column, _: Column) -> Column:
        go = (F.get("_x", F.get("_f", node)) - F.get("_m", node)) * F.get("_s", node) <= F.get("_t", node)
        return F.when(go, F.get("_l", node)).otherwise(F.get("_r", node))

    steps = F.sequence(F.lit(1), F.lit(levels)) if levels else F.array().cast("array<int>")
    leaves = F.transform("_roots", lambda root: F.get("_leaf", F.aggregate(steps, root, down)))
    zero = F.array(*[F.lit(0.0)] * model.n_classes)
    summed = F.aggregate(leaves, zero, lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    return _with_class(_with_probability(x, summed, model.link), keep)


def save_nodes(model: NodeModel, path: str) -> None:
    """The table as Parquet, features, classes and link in every row."""
    model.nodes.select("*", F.array(*map(F.lit, model.features)).alias("features"), F.lit(model.n_classes).alias("n_classes"),
                       F.lit(model.link).alias("link")).write.parquet(path)


def load_nodes(spark: SparkSession, path: str) -> NodeModel:
    t = spark.read.parquet(path)
    r = t.select("features", "n_classes", "link").first()
    return NodeModel(t.drop("features", "n_classes", "link"), list(r["features"]), r["n_classes"], r["link"])
