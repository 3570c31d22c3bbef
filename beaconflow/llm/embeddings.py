"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors lexicographically by the concatenated signs of random projections: close
vectors share long prefixes and come to stand near each other.  A vector is compared with a bounded
window of neighbours, pairs found at or above the cosine are confirmed links, and their union over
the passes gives the components.  Where more vectors share a prefix than a window holds (a hot topic), those of
different components are compared exactly, in bounded blocks.  Links are then counted exactly inside the components, in bounded blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .common import pin
from .graph import components

#: Projections in the key of a pass; rows of one comparison block; rows that one block of a component may have.
BITS, STEP, BLOCK = 32, 512, 1024


def signs_for(n: int, window: int) -> int:
    """Signs of a prefix that half a window of ``n`` evenly spread vectors share; where more than a window do, see run_links."""
    return 0 if n <= window + 1 else min(BITS, math.ceil(math.log2(2 * n / window)))


def passes_for(n: int, cosine: float, window: int, miss: float = 1e-4) -> int:
    """Passes after which a pair at exactly ``cosine`` shared no prefix with a probability of ``miss``.

    Two vectors share a sign with probability 1 - angle / pi.  Those that share a prefix are compared, unless a
    partition's border parts them (at most one place in 64 is that near to one).
    """
    same, signs = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi, signs_for(n, window)
    near = same ** signs * (1 - (signs > 0) / 64)
    return 1 if near >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - near))


def unit(blobs: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length in double precision from packed vectors of one dimension."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares from overflowing
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pass_keys(x: np.ndarray, turn: int) -> np.ndarray:
    """The sort keys of unit vectors in a pass: the signs of BITS projections, the first one highest."""
    planes = np.random.default_rng([turn, x.shape[1]]).standard_normal((x.shape[1], BITS))
    return ((x @ planes) >= 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])


def stars(linked: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index by a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def neighbour_links(rows: DataFrame, cosine: float, window: int, kind: str) -> DataFrame:
    """Links (a, b) between rows of a sorted layout (``turn, dim, sort, id, v``) that stand at most ``window`` apart.

    Pairs at or above the cosine are united per block of rows, and a block's components come out as
    stars: at most one link for each row and block, however dense its neighbourhood.
    """
    made = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_run, held_ids, held = None, np.zeros(0, np.int64), None
        for batch in batches:
            turn, dim = batch.column("turn").to_numpy(), batch.column("dim").to_numpy()
            ids, blobs, out = batch.column("id").to_numpy(), batch.column("v").to_pylist(), ([], [])
            cuts = np.flatnonzero((turn[1:] != turn[:-1]) | (dim[1:] != dim[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if e <= s:
                    continue
                x, i = unit(blobs[s:e], kind), ids[s:e]
                if held_run == (turn[s], dim[s]):
                    x, i = np.concatenate((held, x)), np.concatenate((held_ids, i))
                    first = len(held)
                else:
                    first = 0
                for at in range(first, len(x), STEP):
                    low, top = max(0, at - window), min(len(x), at + STEP)
                    linked = x[low:top] @ x[low:top].T >= cosine
                    place = np.arange(top - low)
                    linked &= np.abs(place[:, None] - place[None, :]) <= window
                    label = stars(linked)
                    hang = np.flatnonzero(label != place)
                    out[0].append(i[low:top][label[hang]])
                    out[1].append(i[low:top][hang])
                held_run, held, held_ids = (turn[e - 1], dim[e - 1]), x[-window:], i[-window:]
            if out[0]:
                a, b = np.concatenate(out[0]), np.concatenate(out[1])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=made)

    return rows.mapInArrow(run, "a long, b long")


def run_links(keys: DataFrame, classes: DataFrame, comp: DataFrame, cosine: float, window: int, kind: str) -> DataFrame | None:
    """Links (a, b) inside runs: vectors that share the prefix of a pass (``turn, dim, prefix, id``), more than a window holds.

    Members of a run's largest component so far are linked already; each of the others is compared with all members, in
    blocks of about BLOCK rows against BLOCK rows, so a run of any size is spread over tasks.  None if there is no such run.
    """
    run = ["turn", "dim", "prefix"]
    size = keys.groupBy(*run).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > window + 1)
    x = pin(keys.join(size, run).join(comp.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("component", F.coalesce("component", "id")), "runs")
    main = x.groupBy(*run, "component", "total").agg(F.count(F.lit(1)).alias("n")).groupBy(*run, "total").agg(
        F.max(F.struct("n", "component")).alias("most"))
    main = main.where("total > most.n").select(*run, F.col("most.component").alias("main"), F.ceil(F.col("total") / BLOCK).alias("blocks"),
                                               F.ceil((F.col("total") - F.col("most.n")) / BLOCK).alias("far_blocks"))
    if main.isEmpty():
        return None
    where = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    x = x.join(main, run).withColumn("p", where % F.col("blocks")).withColumn("q", where % F.col("far_blocks"))
    every = x.select(*run, "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("far_blocks") - 1)).alias("q"), "id", F.lit(False).alias("far"))
    far = x.where("component <> main").select(*run, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("p"), "q", "id", F.lit(True).alias("far"))

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        m, f = t[~t["far"]], t[t["far"]]
        ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(m) and len(f):
            mi, fi = m["id"].to_numpy(), f["id"].to_numpy()
            linked = unit(list(f["v"]), kind) @ unit(list(m["v"]), kind).T >= cosine
            other = linked & (fi[:, None] != mi[None, :])
            r, c = np.flatnonzero(other.any(axis=1)), np.flatnonzero(other.any(axis=0))
            if len(r):
                both, part = np.concatenate((fi[r], mi[c])), linked[np.ix_(r, c)]
                square = np.zeros((len(both), len(both)), bool)
                square[:len(r), len(r):], square[len(r):, :len(r)] = part, part.T
                square |= both[:, None] == both[None, :]  # one vector may stand on both sides
                label = stars(square)
                hang = np.flatnonzero(both[label] != both)
                ids = both[label][hang], both[hang]
        return pd.DataFrame({"a": ids[0], "b": ids[1]})

    both = every.unionByName(far).join(classes.select("id", "v"), "id")
    return both.groupBy(*run, "p", "q").applyInPandas(compare, "a long, b long")


def link_counts(classes: DataFrame, comp: DataFrame, cosine: float, kind: str) -> DataFrame:
    """``id, others``: for each class in a component, the vectors of other classes of the component linked with it.

    Members within half the angle of the component's first vector are linked with one another by the
    triangle inequality and only counted.  Each of the other members is compared with all members, in
    blocks of about BLOCK rows against BLOCK rows, so a component of any size is spread over tasks.
    """
    half = math.acos(max(-1.0, min(1.0, cosine))) / 2 - 1e-7
    member = classes.join(comp.withColumnRenamed("node", "id"), "id").select("component", "id", "copies", "v")
    first = member.where("id = component").select("component", F.col("v").alias("pivot"))

    def angle(cols: dict[str, list]) -> dict[str, list]:
        out = []
        for v, p in zip(cols.pop("v"), cols.pop("pivot")):
            c = float(unit([v], kind)[0] @ unit([p], kind)[0]) if len(v) == len(p) else -1.0
            out.append(math.acos(max(-1.0, min(1.0, c))) <= half)
        return cols | {"core": out}

    near = map_texts(member.join(first, "component").select("component", "id", "copies", "v", "pivot"), angle,
                     "component long, id long, copies long, core boolean", ("v", "pivot"))
    near = pin(near, "cores")
    total = near.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"),
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"),
        F.ceil(F.count(F.when(~F.col("core"), 1)) / BLOCK).alias("far_blocks"))
    x = near.join(total, "component")
    inside = x.where("core").select("id", (F.col("core_copies") - F.col("copies")).alias("others"))
    # far members against all members: block pairs (p: all, q: far)
    where = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    x = x.where("far_blocks > 0").withColumn("p", where % F.col("blocks")).withColumn("q", where % F.col("far_blocks"))
    every = x.select("component", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("far_blocks") - 1)).alias("q"), "id", "copies", "core", F.lit(False).alias("far"))
    far = x.where("not core").select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("p"), "q", "id", "copies", "core", F.lit(True).alias("far"))
    both = every.unionByName(far).join(classes.select("id", "v"), "id")

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        out = []
        size = t["v"].map(len)
        for _, d in t.groupby(size):  # only vectors of one dimension compare
            m, f = d[~d["far"]], d[d["far"]]
            if not len(m) or not len(f):
                continue
            linked = unit(list(f["v"]), kind) @ unit(list(m["v"]), kind).T >= cosine
            linked &= f["id"].to_numpy()[:, None] != m["id"].to_numpy()[None, :]
            out.append(pd.DataFrame({"id": f["id"], "others": linked @ m["copies"].to_numpy()}))
            core = m["core"].to_numpy()  # far members meet each other from both sides, core ones only here
            out.append(pd.DataFrame({"id": m["id"][core], "others": f["copies"].to_numpy() @ linked[:, core]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "others": []}, dtype="int64")

    met = both.groupBy("component", "p", "q").applyInPandas(compare, "id long, others long")
    return inside.unionByName(met).groupBy("id").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", cosine: float = 0.9,
                    window: int = 64) -> DataFrame:
    """``key, n_links`` (other vectors linked directly), ``component_id`` (smallest key reachable), ``kept`` per row.

    Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing; nor do
    vectors of different length.  Equal vectors are one class that stands for its rows.  Rows
    without a key are left alone (component_id null, kept); keys are taken as integers, and rows
    with the same key count as vectors of their own.  Other columns are ignored.
    """
    single = vectors.schema[vec].dataType.simpleString() == "array<float>"
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    x = vectors.select(F.col(key).cast("long").alias("k"), F.col(vec).cast(cast).alias("e"))
    fine = F.coalesce(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
                      & F.exists("e", lambda c: c != 0), F.lit(False)) & F.col("k").isNotNull()
    x = x.select("k", "e", fine.alias("fine"), *[F.when(fine, F.xxhash64(F.lit(i), F.col("e"))).alias(f"h{i}") for i in (1, 2)])

    def packed(cols: dict) -> dict:
        e = cols.pop("e")
        flat, ends = e.values.to_numpy(zero_copy_only=False), e.offsets.to_numpy()
        return cols | {"v": [flat[a:b].astype(kind).tobytes() for a, b in zip(ends, ends[1:])]}

    groups = x.where("fine").groupBy("h1", "h2").agg(F.min("k").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("e").alias("e"))
    # written with an id for each class: one key may come with several vectors
    classes = pin(map_texts(groups, packed, "h1 long, h2 long, low long, copies long, v binary", ("e",), ("e",))
                  .withColumn("id", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    turns, signs = passes_for(n, cosine, window), signs_for(n, window)

    def sort_keys(cols: dict[str, list], whole: bool = True) -> dict[str, list]:
        out = {c: [] for c in (("turn", "dim", "sort", "id", "v") if whole else ("turn", "dim", "prefix", "id"))}
        size = np.array([len(v) for v in cols["v"]])
        for dim in np.unique(size).tolist():
            at = np.flatnonzero(size == dim)
            blobs, ids = [cols["v"][i] for i in at], [cols["id"][i] for i in at]
            x = unit(blobs, kind)
            for t in range(turns):
                key = pass_keys(x, t) if whole else pass_keys(x, t) >> (BITS - signs)
                for c, v in zip(out, ([t] * len(at), [dim] * len(at), key.tolist(), ids, blobs)):
                    out[c] += v
        return out

    rows = map_texts(classes.select("id", "v"), sort_keys, "turn int, dim int, sort long, id long, v binary", ("v",))
    # a partition holds many windows, so few neighbours are parted by its borders
    parts = max(1, n * turns // (64 * window))
    rows = rows.repartitionByRange(parts, "turn", "dim", "sort", "id").sortWithinPartitions("turn", "dim", "sort", "id")
    links = pin(neighbour_links(rows, cosine, window, kind).distinct(), "links")
    comp = components(links)
    keys = map_texts(classes.select("id", "v"), lambda cols: sort_keys(cols, False), "turn int, dim int, prefix long, id long", ("v",))
    more = run_links(keys, classes, comp, cosine, window, kind) if signs else None
    if more is not None:
        comp = components(links.unionByName(more).distinct())
    counts = link_counts(classes.select("id", "copies", "v"), comp, cosine, kind)
    node = comp.withColumnRenamed("node", "id")
    named = classes.select("id", "low").join(node, "id").groupBy("component").agg(F.min("low").alias("c"))
    place = (classes.select("h1", "h2", "low", "id", "copies").join(node.join(named, "component").select("id", "c"), "id", "left")
             .join(counts, "id", "left").select("h1", "h2", F.coalesce("c", "low").alias("c"),
                                                (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n")))
    out = x.join(place, ["h1", "h2"], "left").select(
        F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "k").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
