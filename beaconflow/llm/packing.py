"""Packing of token sequences by the configuration linear program.

Pieces are counted by length, so the packing problem is as large as the sequence length, not the
corpus.  Its linear program (how often to use each configuration of lengths that fits one sequence) is
solved by multiplicative weights: a knapsack dynamic program prices the best configuration under the
present weights, and lengths that it covers lose weight.  The fractional solution is rounded down and what is left is
covered the same way by whole uses.  Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .common import before, laid_out, pin
from .tokens import encoder


def price(weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with unbounded copies: the best weight of each room ``0..capacity`` and the length taken there (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(weight > 0)
    gain = weight[lengths]
    for c in range(int(lengths[0]) if len(lengths) else capacity + 1, capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        v = best[c - lengths[:n]] + gain[:n]
        i = int(v.argmax())
        if v[i] > best[c - 1]:
            best[c], take[c] = v[i], lengths[i]
        else:
            best[c] = best[c - 1]
    return best, take


def best_with_each(weight: np.ndarray, capacity: int):
    """For each length, the longest first, the configuration of most weight that holds it."""
    _, take = price(weight, capacity)
    for l in np.flatnonzero(weight > 0)[::-1].tolist():
        found, c = Counter([l]), capacity - l
        while c > 0:
            if take[c]:
                found[int(take[c])] += 1
                c -= int(take[c])
            else:
                c -= 1
        yield found


def refill(config: Counter, left: np.ndarray, capacity: int) -> tuple[Counter, int]:
    """``config`` without the copies that are not there (pricing knows no limits), the room given to the longest that fit."""
    out = Counter({l: int(min(k, left[l])) for l, k in config.items() if left[l] > 0})
    filled = sum(l * k for l, k in out.items())
    if out != config:
        for l in np.flatnonzero(left[:capacity - filled + 1])[::-1].tolist():
            k = int(min(left[l] - out[l], (capacity - filled) // l))
            if k > 0:
                out[l] += k
                filled += k * l
    return out, filled


def steps(need: np.ndarray, capacity: int, eta: float, eps: float, bend: float, whole: bool):
    """Multiplicative weights on the covering program: yields (configuration, uses) and takes them from ``need``.

    A length's weight starts above its share of a sequence (``bend`` favours long pieces, which fit worst) and is
    multiplied after each step by ``exp(eta * lag)``, where lag is the part of its pieces not yet covered beyond the mean.
    A step uses the best configuration with each length, the longest first, for a part ``eps`` of its scarcest pieces,
    if it fills a sequence but for a part ``within``; that part doubles when no configuration does, up to 1, where every one
    does.  ``whole``: uses are whole numbers and take only pieces that are there, to the last one.  Otherwise uses are real,
    and the steps end when a thousandth of the mass is left.  Each step first yields (None, bound): by duality no packing
    has fewer sequences than the needs' total weight over the most weight that a sequence can hold.
    """
    left, total = need.copy(), np.maximum(need, 1)
    size = np.arange(capacity + 1) / capacity
    mass = size * need
    boost, within = np.zeros(capacity + 1), 0.0005
    while left.sum() > 0 and (whole or (size * left).sum() > 0.001 * mass.sum()):
        lag = left / total
        boost += eta * (lag - (lag * mass).sum() / mass.sum())
        weight, placed = np.where(left > 0, size * (1 + bend * size) * np.exp(boost), 0), 0
        yield None, float((weight * need).sum() / price(weight, capacity)[0][capacity])
        for p in best_with_each(weight, capacity):
            if whole:
                p, filled = refill(p, left, capacity)
            else:
                p = Counter({l: k for l, k in p.items() if left[l] > 0})
                filled = sum(l * k for l, k in p.items())
            if not p or filled < (1 - within) * capacity:
                continue
            most = min(left[l] // k if whole else left[l] / k for l, k in p.items())
            n = int(min(most, max(1, eps * most))) if whole else most if most < 0.5 else eps * most
            placed += n
            for l, k in p.items():
                left[l] = max(left[l] - n * k, 0)
            yield tuple(sorted(p.items())), n
        if not placed:
            within = min(2 * within, 1.0)


def solve(histogram: np.ndarray, capacity: int, eta: float, eps: float = 0.2, bend: float = 1.0) -> tuple[Counter, float]:
    """Uses of configurations ((length, copies), ...) that together give every piece a place, and a lower bound.

    A fractional solution of the covering program is rounded down; the pieces that this leaves are covered the same way by
    whole uses of priced configurations, to the last piece.
    """
    share, bound = Counter(), float(np.ceil((np.arange(capacity + 1) * histogram).sum() / capacity))
    for config, n in steps(histogram.astype(float), capacity, eta, eps, bend, whole=False):
        if config is None:
            bound = max(bound, float(np.ceil(n - 1e-6)))
        else:
            share[config] += n
    left, used = histogram.astype(np.int64).copy(), Counter()
    for config, x in share.items():
        n = int(x + 1e-9)
        if n and all(left[l] >= n * k for l, k in config):
            used[config] += n
            for l, k in config:
                left[l] -= n * k
    for config, n in steps(left, capacity, eta, eps, bend, whole=True):
        if config is not None:
            used[config] += n
    return used, bound


def configurations(histogram: np.ndarray, capacity: int, settings: tuple[tuple[float, float], ...] = ((0.005, 0.2), (0.005, 0.5), (0.01, 0.2))) -> list[tuple[tuple, int]]:
    """The best of the solutions for a few ``settings`` (learning rate, part of a step); the first that meets its lower bound.

    Its size is bounded by ``capacity`` and the steps (logarithmic in the number of pieces), not by the corpus.
    """
    best: Counter | None = None
    for rate, part in settings:
        used, bound = solve(histogram, capacity, rate, part)
        if best is None or sum(used.values()) < sum(best.values()):
            best = used
        if sum(best.values()) <= bound:  # no packing has fewer
            break
    return sorted(best.items())


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every row: ``key, piece, start, length, ids_crc32``.

    A document is its ids (null text: none) and ``end_id``.  One longer than ``capacity`` is cut into
    pieces of that length, of which the first may be shorter.
    """
    kind = docs.schema[key].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        enc, out = encoder(path), {c: [] for c in ("k", "piece", "start", "length", "ids_crc32")}
        for k, t in zip(rows["k"], rows["text"]):
            ids = np.append(enc.encode(t or ""), np.uint32(end_id)).astype("<u4")
            edges = list(range(len(ids), 0, -capacity)) + [0]
            for i, (a, b) in enumerate(zip(edges[:0:-1], edges[-2::-1])):
                for c, v in zip(out, (k, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                    out[c].append(v)
        return out

    x = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    return map_texts(x, work, f"k {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


def places(plan: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies, first sequence, offset): where the pieces of a length go, by rank."""
    rows, sequence, taken = [], 0, Counter()
    for config, uses in plan:
        at = 0
        for l, k in config:
            rows.append((l, taken[l], taken[l] + uses * k, k, sequence, at))
            taken[l] += uses * k
            at += l * k
        sequence += uses
    return rows


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (its place there, gapless from 0), in few sequences of ``capacity``.

    Only counts by length reach the driver.  Ranks within a length come from running totals over range
    partitions, so a length that most pieces share is spread over many tasks.  Equal or null keys are
    separate documents; no documents, no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    # written before it is counted, sampled and dealt out: texts are encoded once
    p = laid_out(pin(pieces(docs, path, capacity, end_id, key, text), "encoded"), ["length", key, "piece", "ids_crc32"], "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for l, n in p.groupBy("length").count().collect():
        counts[l] = n
    plan = places(configurations(counts, capacity)) if counts.any() else []
    # bounded by the sequence length and the solver's steps (see configurations)
    where = spark.createDataFrame(plan, "_l long, _a long, _b long, _k long, _s long, _o long")
    x = before(p, {"_rank": F.lit(1)}, ["length"]).join(F.broadcast(where), F.expr("length = _l and _rank >= _a and _rank < _b"))
    return x.select(key, "piece", "start", "length", "ids_crc32",
                    (F.col("_s") + F.floor((F.col("_rank") - F.col("_a")) / F.col("_k"))).alias("sequence_id"),
                    (F.col("_o") + F.pmod(F.col("_rank") - F.col("_a"), F.col("_k")) * F.col("length")).alias("offset"))
