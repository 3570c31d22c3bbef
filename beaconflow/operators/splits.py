"""Splits and sampling X1-X5 (deterministic, hash-ordered, no collected row data).

NumPy's permutations cannot be reproduced; every random order here is the
order of ``md5('<seed>:<key>')``, which Spark and DuckDB compute identically.
Cut-offs in hash order come from hash-prefix block counts (aggregates only);
size ranks come from ``rank_within`` (range partitions + offsets).  No step puts
all senders or all rows of a class into one task.  Only per-class cut-off
values (one row per class and cut) are brought back to the rows, by a broadcast join
on the class (a shuffle by class would put all rows of a class into one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import hash_cutoffs_by_size, rank_within


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


def row_hash(df: DataFrame, key: str, seed: int) -> Column:
    """``seeded_hash`` of the key; a row without a key is hashed by all its other columns, in name order.

    So rows without a key are dealt like any others; only rows that are equal in every column share a hash.
    """
    others = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(set(df.columns) - {key})]
    own = F.concat_ws("|", F.lit("null"), *others)
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.coalesce(F.col(key).cast("string"), own)))


def _cutoffs(keys: DataFrame, group_cols: list[str], hcol: str, counts_to_cuts) -> DataFrame:
    """Per group and cut, the hash at rank k (hash order inside the group).

    ``counts_to_cuts(n)`` maps the group size to an ordered list of ranks ``k``; the
    result has one row per (group, cut index) with ``_cut`` (NULL when k == n:
    everything is before the cut).  Uses hash-prefix blocks: aggregates only, and only the
    rows of the blocks holding a cut are ordered.
    """
    return hash_cutoffs_by_size(keys, group_cols, hcol, counts_to_cuts)


def group_holdout(df: DataFrame, group: str = "senderpseudo", ratio: float = 0.8, seed: int = 42,
                  names: tuple[str, str] = ("train_val", "test"), out: str = "split") -> DataFrame:
    """Whole senders to one side; the first ``floor(ratio * n_senders)`` senders in hash order -> names[0]."""
    h = seeded_hash(group, seed)
    senders = df.select(group).distinct().where(F.col(group).isNotNull()).withColumn("_h", h)
    cut = _cutoffs(senders, [], "_h",
                   lambda n: F.array(F.floor(F.lit(float(ratio)) * n).cast("long")))
    # One value (the hash at the cut rank), computed once and used as a literal, so
    # every later branch over the split reuses it instead of re-running the cut jobs.
    thr = cut.select("_cut").first()[0]
    first = F.lit(True) if thr is None else (h < F.lit(thr))
    return df.withColumn(out, F.when(F.col(group).isNull(), F.lit(None).cast("string"))
                         .when(first, F.lit(names[0])).otherwise(F.lit(names[1])))


def repeated_group_holdout(df: DataFrame, trials: int, group: str = "senderpseudo", ratio: float = 0.85,
                           seed: int = 42) -> DataFrame:
    """One sender split per trial, seed = seed + trial (long form: trial, group, split)."""
    senders = df.select(group).distinct()
    out = None
    for t in range(trials):
        s = group_holdout(senders, group, ratio, seed + t).withColumn("trial", F.lit(t))
        out = s if out is None else out.unionByName(s)
    return out


def stratified_split(df: DataFrame, label: str = "class", key: str = "row_id", test: float = 0.2, val: float = 0.2,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """Per class, first floor(test*n) rows in hash order -> test, next floor(val*(n - n_test)) -> val, rest -> train.

    ``key`` must identify rows uniquely: rows with equal keys share a hash and always
    fall on the same side of a cut.  Rows without a key are dealt by ``row_hash``.
    """
    hk = row_hash(df, key, seed)
    keys = df.select(label, hk.alias("_h"))

    def cuts(n):
        nt = F.floor(F.lit(float(test)) * n).cast("long")
        nv = F.floor(F.lit(float(val)) * (n - nt)).cast("long")
        return F.array(nt, nt + nv)
    c = _cutoffs(keys, [label], "_h", cuts)
    wide = c.groupBy(label).agg(F.max(F.when(F.col("_ci") == 0, F.col("_cut"))).alias("_c_test"),
                                F.max(F.when(F.col("_ci") == 1, F.col("_cut"))).alias("_c_val"),
                                F.max(F.when(F.col("_ci") == 0, F.col("_k"))).alias("_k_test"),
                                F.max(F.when(F.col("_ci") == 1, F.col("_k"))).alias("_k_val"))
    j = df.withColumn("_h", hk).join(F.broadcast(wide), df[label].eqNullSafe(wide[label]), "left").drop(wide[label])

    def before(cut, k):  # rank < k  <=>  hash < hash at rank k (hashes are distinct)
        return F.when(F.col(k) == 0, F.lit(False)).otherwise(F.coalesce(F.col("_h") < F.col(cut), F.lit(True)))
    split = (F.when(before("_c_test", "_k_test"), F.lit("test"))
             .when(before("_c_val", "_k_val"), F.lit("val")).otherwise(F.lit("train")))
    return j.withColumn(out, split).drop("_h", "_c_test", "_c_val", "_k_test", "_k_val")


def stratified_sample(df: DataFrame, label: str = "class", rate: float = 0.2, key: str = "row_id",
                      seed: int = 42) -> DataFrame:
    """Exactly floor(rate * n_c) rows per class, without replacement (first in hash order).

    ``key`` must identify rows uniquely (equal keys share a hash and are kept or dropped together).  Rows
    without a key are dealt by ``row_hash``.
    """
    hk = row_hash(df, key, seed)
    c = _cutoffs(df.select(label, hk.alias("_h")), [label], "_h",
                 lambda n: F.array(F.floor(F.lit(float(rate)) * n).cast("long")))
    c = c.select(label, "_k", "_cut")
    j = df.withColumn("_h", hk).join(F.broadcast(c), df[label].eqNullSafe(c[label]), "inner").drop(c[label])
    keep = F.when(F.col("_k") == 0, F.lit(False)).otherwise(F.coalesce(F.col("_h") < F.col("_cut"), F.lit(True)))
    return j.where(keep).drop("_h", "_k", "_cut")


def _deal(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Folds of groups, largest first, each to the fold with the fewest rows (ties: the lowest fold).

    ``sizes``: (size, number of groups), largest first.  Groups of one size are dealt together: rows
    (size, first rank, end rank, cycle) say that the group of rank r gets ``cycle[(r - first) % len]``.  While the
    lightest folds stay below the next one they take turns, so whole rounds are booked at once.
    """
    load, rows = [0] * k, []
    for size, n in sizes:
        rank = 0
        while rank < n:
            order = sorted(range(k), key=lambda f: (load[f], f))
            # the folds within one group of the lightest take one each, in this order, before any takes a second
            turn = [f for f in order if load[f] - load[order[0]] < size]
            above = [load[f] for f in order[len(turn):]]
            rounds = (n - rank) // len(turn)
            if above:  # as long as even the heaviest of them stays below the next fold
                rounds = min(rounds, max(0, (min(above) - load[turn[-1]] - 1) // size))
            if rounds < 1:
                turn, rounds = [order[0]], 1
            rows.append((size, rank, rank + rounds * len(turn), turn))
            for f in turn:
                load[f] += rounds * size
            rank += rounds * len(turn)
    return rows


def sender_folds(df: DataFrame, group: str = "senderpseudo", k: int = 5) -> DataFrame:
    """Fold per sender: the largest sender first, each to the fold with the fewest rows so far (ties: lowest fold,
    equal senders by id).

    The rule only sees sizes, so the driver deals the table of distinct sizes (its rows are at most
    the square root of twice the number of messages); senders find their fold by their rank within their size.
    """
    spark = df.sparkSession
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    r = rank_within(sizes, ["n_rows"], [F.col(group).asc()])
    table = sorted(((x["n_rows"], x["n"]) for x in r.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    dealt = spark.createDataFrame(_deal(table, k), "_size long, _a long, _b long, _turn array<int>")
    j = r.join(dealt, (F.col("n_rows") == F.col("_size")) & (F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_b")))
    place = F.pmod(F.col("_rank") - F.col("_a"), F.size("_turn").cast("long")).cast("int")
    return j.select(group, "n_rows", F.get(F.col("_turn"), place).cast("int").alias("fold"))


def group_kfold(df: DataFrame, group: str = "senderpseudo", k: int = 5, out: str = "fold") -> DataFrame:
    """Add a fold column; no sender is in two folds.

    The sender -> fold table is joined back on the sender.  AQE broadcasts it
    when its measured size is small and otherwise splits a hot sender's rows
    over several tasks (skew join), so no task receives a whole hot sender.
    """
    folds = sender_folds(df, group, k).select(group, F.col("fold").alias(out))
    return df.join(folds, group, "left")
