"""Distributed ranking without a single-task window.

``row_number() OVER (ORDER BY ...)`` without PARTITION BY, or a window per
class, runs in one task; a class (or the whole table) can be arbitrarily large.
``rank_within`` instead range-partitions on (group, order), sorts inside each
partition, pins the layout with a reliable checkpoint, and turns per-partition
counts into offsets (a table of at most ``num_partitions`` rows).  Every task
handles at most one range partition.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows that a range partition of a ranking should hold.
ROWS_PER_PARTITION = 2_000_000
#: Hex characters by which a hash prefix grows, and rows that the last window of a cut may order.
PREFIX_STEP, LAST_WINDOW = 3, 10_000


def rank_within(df: DataFrame, group_cols: list[str], order: list[Column | str],
                weight: Column | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``_rank`` (0-based position inside the group, in ``order``) and ``_w``.

    With ``weight`` each row stands for ``weight`` equal items and ``_rank`` is
    the position of its first item (so a row covers ranks ``[_rank, _rank+_w)``).
    Ties in ``order`` get distinct, arbitrary-but-stable ranks.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if num_partitions is None:
        # counting, sampling the ranges and dealing the rows out read the input three times: it is computed once
        df = df.checkpoint(eager=True)
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_PARTITION))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(c) for c in group_cols] + order_cols
    srt = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id())
           .withColumn("_w", (weight if weight is not None else F.lit(1)).cast("long")))
    # Reliable checkpoint: partition ids and in-partition order are fixed from here on,
    # so the offsets computed below always describe the same layout (also after a lost executor).
    srt = srt.checkpoint(eager=True)
    part = srt.groupBy("_pid").agg(F.sum("_w").alias("_pw"))
    part = part.withColumn("_poff", F.coalesce(
        F.sum("_pw").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if weight is None:
        # monotonically_increasing_id = partition id << 33 | position in the partition:
        # the in-partition rank needs no window (and no shuffle)
        x = srt.withColumn("_cw", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    else:
        inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        x = srt.withColumn("_cw", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    # at most num_partitions rows: a proven bound for broadcasting
    x = x.join(F.broadcast(part.select("_pid", "_poff")), "_pid").withColumn("_g_lo", F.col("_poff") + F.col("_cw"))
    if group_cols:
        start = x.groupBy(*[F.col(c).alias(f"_s_{c}") for c in group_cols]).agg(F.min("_g_lo").alias("_gstart"))
        same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in group_cols]  # rows without a group are a group too
        x = x.join(start, same).withColumn("_rank", F.col("_g_lo") - F.col("_gstart")).drop("_gstart", *start.columns)
    else:
        x = x.withColumn("_rank", F.col("_g_lo"))
    return x.drop("_pid", "_mid", "_cw", "_poff", "_g_lo")


def values_at_ranks(ranked: DataFrame, group_cols: list[str], targets: DataFrame, value_cols: list[str]) -> DataFrame:
    """For each target row (group_cols + ``_target``), the ranked row covering that rank.

    ``targets`` is small (a few ranks per group) and is broadcast; each ranked
    row probes only its own group's targets.
    """
    t = targets.select(*[F.col(c).alias(f"_t_{c}") if c in group_cols else F.col(c) for c in targets.columns])
    r = ranked.select(*group_cols, "_rank", "_w", *value_cols)
    cond = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in group_cols]
    cond.append(F.col("_target") >= F.col("_rank"))
    cond.append(F.col("_target") < F.col("_rank") + F.col("_w"))
    j = r.join(F.broadcast(t), cond, "inner")
    others = [c for c in targets.columns if c not in group_cols]
    return j.select(*[F.col(f"_t_{c}").alias(c) for c in group_cols], *others, *value_cols)


def hash_cutoffs_by_size(keys: DataFrame, group_cols: list[str], hcol: str, counts_to_cuts) -> DataFrame:
    """Like ``hash_rank_cutoffs`` with the ranks derived from each group's size.

    ``counts_to_cuts(size)`` -> array of ranks.  Returns group_cols + ``_ci`` (cut index) + ``_k`` + ``_cut``.
    """
    sizes = keys.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_size"))
    cuts = sizes.select(*group_cols, F.posexplode(counts_to_cuts(F.col("_size"))).alias("_ci", "_k")).checkpoint(eager=True)
    found = hash_rank_cutoffs(keys, group_cols, hcol, cuts.select(*group_cols, "_k"))
    f = found.select(*[F.col(c).alias(f"_f_{c}") for c in group_cols], F.col("_k").alias("_fk"), "_cut").distinct()
    cond = [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in group_cols] + [F.col("_k") == F.col("_fk")]
    return cuts.join(f, cond, "left").select(*group_cols, "_ci", "_k", "_cut")


def hash_rank_cutoffs(keys: DataFrame, group_cols: list[str], hcol: str, targets: DataFrame,
                      step: int = PREFIX_STEP, last: int = LAST_WINDOW) -> DataFrame:
    """The value of ``hcol`` (a lowercase hex digest) at rank ``_k`` inside each group, without sorting all rows.

    Digests are uniform, so their first ``step`` hex characters cut every group into nearly equal
    blocks.  Block counts (an aggregate) and their running sums (a window over at most 16**step rows per
    group and cut) locate the block that holds rank k.  A block that still has more than ``last`` rows
    is cut again by the next characters, so what is ordered in the end is bounded whatever the
    input.  Rows without a group form a group.  ``targets`` = group_cols + ``_k`` (small).  Returns group_cols + ``_k`` +
    ``_cut`` (NULL when k is at or beyond the group size).
    """
    ensure_checkpoint_dir(keys.sparkSession)
    # without groups all rows share a constant, so that every join below has an equality
    group = group_cols or ["_all"]
    if not group_cols:
        keys, targets = keys.withColumn("_all", F.lit(0)), targets.withColumn("_all", F.lit(0))
    gt = [f"_g{i}" for i in range(len(group))]
    aim = targets.select(*[F.col(c).alias(g) for c, g in zip(group, gt)], "_k").distinct().withColumn(
        "_prefix", F.lit("")).withColumn("_need", F.col("_k")).checkpoint(eager=True)
    rows, width = keys.select(*[F.col(c).alias(f"_r{g}") for c, g in zip(group, gt)], F.col(hcol).alias("_hash")), 0
    same = [F.col(f"_r{g}").eqNullSafe(F.col(g)) for g in gt]
    while True:
        # rows of the blocks that hold a rank (all rows at first); those blocks shrink by 16**step a turn
        cand = rows.withColumn("_block", F.substring("_hash", 1, width))
        blocks = aim.select(*gt, "_prefix").distinct()  # no more rows than targets: a shuffle by group would gather a group
        cand = cand.join(F.broadcast(blocks), same + [F.col("_block") == F.col("_prefix")]).select(*rows.columns, "_prefix")
        width += step
        counts = cand.groupBy(*[f"_r{g}" for g in gt], "_prefix", F.substring("_hash", 1, width).alias("_next")).agg(
            F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*[f"_r{g}" for g in gt], "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumnRenamed("_prefix", "_of")
        hit = counts.join(aim.select(*gt, "_k", "_prefix", "_need"), same + [F.col("_of") == F.col("_prefix")]).where(
            (F.col("_need") >= F.col("_before")) & (F.col("_need") < F.col("_before") + F.col("_n")))
        aim = hit.select(*gt, "_k", F.col("_next").alias("_prefix"), (F.col("_need") - F.col("_before")).alias("_need"), "_n").checkpoint(eager=True)
        most = aim.agg(F.max("_n")).first()[0]
        if most is None or most <= last or width >= 32:
            break
    cand = rows.withColumn("_block", F.substring("_hash", 1, width)).join(
        F.broadcast(aim.select(*gt, "_prefix").distinct()), same + [F.col("_block") == F.col("_prefix")]).select(*[f"_r{g}" for g in gt], "_block", "_hash")
    w = Window.partitionBy(*[f"_r{g}" for g in gt], "_block").orderBy("_hash")
    at = cand.withColumn("_place", F.row_number().over(w) - 1)
    found = at.join(aim, same + [F.col("_block") == F.col("_prefix"), F.col("_place") == F.col("_need")]).select(
        *gt, F.col("_k").alias("_fk"), F.col("_hash").alias("_cut"))
    cond = [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(group, gt)] + [F.col("_k") == F.col("_fk")]
    return targets.join(found, cond, "left").select(*group_cols, "_k", "_cut")


def file_order_index(df: DataFrame, name: str = "_idx") -> DataFrame:
    """Dense 0-based index in file order (file name, place in the file), without a sort.

    ``df`` is a file scan, or projection of one; files are ordered by path, their splits by offset (Spark packs splits
    into tasks by size, so task order is no file order).  Counts per split become offsets.  A frame without files is
    numbered in partition order.
    """
    try:
        x = df.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_path").alias("_path"),
                      F.col("_metadata.file_block_start").alias("_start"))
    except AnalysisException:
        x = df.select("*", F.lit(0).cast("long").alias("_file"), F.lit("").alias("_path"), F.spark_partition_id().cast("long").alias("_start"))
    x = x.withColumn("_mid", F.monotonically_increasing_id())
    part = x.groupBy("_file", "_start").agg(F.first("_path").alias("_path"), F.count(F.lit(1)).alias("_pn"), F.min("_mid").alias("_m0"))
    part = part.withColumn("_off", F.coalesce(  # one row per file split
        F.sum("_pn").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = x.join(part.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_off", "_m0"),
               (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return j.select(*df.columns, (F.col("_off") + F.col("_mid") - F.col("_m0")).alias(name))
