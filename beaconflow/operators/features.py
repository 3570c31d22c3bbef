"""Per-sender sequence features F1-F18.

Semantics (per sender, in ``order`` order): position in the sender's sequence,
lag-1 differences of speed / position / heading (0 for the first message or
next to a missing value), magnitudes, whole-sender sample std of speed and
position change (0 for a single message), a counter-based hour, and two
interaction terms; every remaining missing value becomes 0.  A message without
a sender has sequence 0, all differences and stds 0.

Scale design.  A plain ``Window.partitionBy(sender)`` puts every message of a
sender into one task; one sender may hold a third of all rows.  Sender sizes
are counted first (a partial aggregate).  When no sender exceeds the bound, one
window per sender does everything: one shuffle, no join.  Senders above it are cut at
quantiles of their own order key, and parts that are still above it are cut again, so that a part holds
about as many rows as the bound whatever the key looks like (a clock gone wrong changes nothing) and however
many rows a sender has; rows are windowed by (sender, part).  One small aggregate per (sender, part) carries
what crosses a border: the row count (for the running position), the lagged
values of the last message (for the first lag of the next part), and mergeable moments
(n, mean, M2) for the two whole-sender stds; an equi-join on (sender, part) brings
them back.  Messages without a sender have no sequence and are spread by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import d

# Columns whose lag-1 difference is a feature: (source column, feature name).
_DIFFS = [
    ("spdx", "acceleration_x"),
    ("spdy", "acceleration_y"),
    ("posx", "position_change_x"),
    ("posy", "position_change_y"),
    ("hedy", "heading_change"),
]
_LAGGED = [c for c, _ in _DIFFS]


def _hyp(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


#: Parts into which one step cuts a sender, or a part of one, at most; still larger parts are cut again.
MOST_PARTS = 1000


def with_parts(df: DataFrame, group: str, order: str, rows_per_part: int) -> DataFrame | None:
    """``df`` with ``_b``, the part of its sender that a row belongs to, ascending with the order key; None when no
    sender has more than ``rows_per_part`` rows.

    Every step counts the rows of each (sender, part), cuts those above the bound at quantiles of their own order keys, and
    goes on until none is left that two different keys could divide.  A step's cuts are joined to the rows by (sender,
    part): at most rows / rows_per_part rows with MOST_PARTS keys each, found by halving.
    """
    key, cut, steps = F.col(order).cast("double"), False, [i / MOST_PARTS for i in range(1, MOST_PARTS)]
    rows = df.withColumn("_b", F.lit(0).cast("long"))
    while True:
        sizes = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_cg"), F.col("_b").alias("_cb")).agg(
            F.count(F.lit(1)).alias("_cn"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        large = sizes.where((F.col("_cn") > rows_per_part) & (F.col("_lo") < F.col("_hi"))).select("_cg", "_cb", "_cn", "_lo").checkpoint(eager=True)
        if large.isEmpty():
            return rows if cut else None
        cut, same = True, [F.col(group) == F.col("_cg"), F.col("_b") == F.col("_cb")]
        q = rows.select(group, "_b", key.alias("_ko")).join(large, same).groupBy("_cg", "_cb").agg(
            F.first("_cn").alias("_cn"), F.first("_lo").alias("_lo"), F.percentile_approx("_ko", steps, 10 * MOST_PARTS).alias("_q"))
        parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("_cn") / rows_per_part)).cast("int")
        at = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.floor(i * F.lit(MOST_PARTS) / parts).cast("int") - 1)
        # a row goes behind every cut below its key; the least key itself separates copies of it from the rest
        found = F.array_sort(F.array_distinct(F.concat(F.transform(at, lambda i: F.get(F.col("_q"), i)), F.array("_lo"))))
        cuts = q.where(parts > 1).select("_cg", "_cb", F.filter(found, lambda c: c >= F.col("_lo")).alias("_cuts"))
        rows = rows.join(cuts, same, "left")
        span = F.struct(F.lit(0).alias("lo"), F.size("_cuts").alias("hi"))

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            below = F.get(F.col("_cuts"), mid) < key
            return F.struct(F.when((s["lo"] < s["hi"]) & below, mid + 1).otherwise(s["lo"]).alias("lo"),
                            F.when((s["lo"] < s["hi"]) & ~F.coalesce(below, F.lit(False)), mid).otherwise(s["hi"]).alias("hi"))

        place = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_PARTS.bit_length() + 1)), span, halve, lambda s: s["lo"])
        part = F.when(F.col("_cuts").isNull() | key.isNull(), F.lit(0)).otherwise(place)
        rows = rows.withColumn("_b", F.col("_b") * (MOST_PARTS + 1) + part).drop("_cg", "_cb", "_cuts")


def engineer_features(df: DataFrame, group: str = "senderpseudo", order: str = "row_id",
                      tiebreak: str | None = None, fixed: bool = False,
                      bucket_width: float | Column | None = None, rows_per_part: int = 1 << 20,
                      keep: list[str] | None = None) -> DataFrame:
    """Add the 17 sequence features to ``df`` (``keep`` selects the passed-through columns;
    default: all input columns).

    ``order`` (plus ``tiebreak``) must order each sender's messages uniquely, as for
    any lag: with ties the previous message is not defined.  Senders with more than
    ``rows_per_part`` rows are cut (``with_parts``); ``bucket_width`` cuts every sender at
    multiples of a width of the order key instead, without counting.

    ``fixed=True`` repairs the two reference quirks: ``night_hours`` uses
    ``hour >= 22 or hour < 5`` instead of an empty interval, and an extra
    ``inter_arrival_seconds`` (difference of ``sendtime``) is added.
    """
    ordering = [F.col(order)] + ([F.col(tiebreak)] if tiebreak else [])
    ord_struct = F.struct(*ordering)
    if fixed and "sendtime" not in _LAGGED:
        lagged = _LAGGED + ["sendtime"]
    else:
        lagged = list(_LAGGED)

    # Non-nullable surrogate keys: a NULL sender is its own group, and no
    # null-rejecting filter gets inferred into one branch of the join below.
    base = keep if keep is not None else df.columns
    inputs = ["spdx", "spdy", "posx", "posy", "hedy", "hedx_n"] + (["sendtime"] if fixed else [])
    needed = list(dict.fromkeys([*base, group, order, *([tiebreak] if tiebreak else []), *inputs]))
    df = df.select(*[F.col(f"`{c}`") for c in needed])
    if bucket_width is not None:
        width = bucket_width if isinstance(bucket_width, Column) else d(bucket_width)
        df, cut = df.withColumn("_b", F.coalesce(F.floor(F.col(order).cast("double") / width), F.lit(-(1 << 62)))), True
    else:
        parted = with_parts(df, group, order, rows_per_part)
        df, cut = (parted, True) if parted is not None else (df, False)
    salt = F.pmod(F.xxhash64(order), F.lit(1 << 20)).cast(df.schema[group].dataType)
    rows = df.withColumn("_gn", F.col(group).isNull()).withColumn("_g", F.coalesce(F.col(group), salt))
    keys = ["_g", "_gn"]
    if cut:
        keys = [*keys, "_b"]
    wb = Window.partitionBy(*keys).orderBy(*ordering)
    rows = rows.withColumn("_rn", F.row_number().over(wb))
    for c in lagged:
        rows = rows.withColumn(f"_l_{c}", F.lag(c).over(wb))
    speed = _hyp(F.col("spdx"), F.col("spdy"))
    # Position change inside the bucket (the bucket's first row is resolved later).
    pc_in = F.when(F.col("_rn") > 1, _hyp(F.coalesce(F.col("posx") - F.col("_l_posx"), d(0)),
                                          F.coalesce(F.col("posy") - F.col("_l_posy"), d(0))))
    rows = rows.withColumn("_speed", speed)
    if not cut:
        whole = Window.partitionBy(*keys)
        pc = _hyp(F.coalesce(F.col("posx") - F.col("_l_posx"), d(0)), F.coalesce(F.col("posy") - F.col("_l_posy"), d(0)))
        out = (rows.withColumn("_off", F.lit(0)).withColumn("_s_std", F.stddev_samp("_speed").over(whole))
               .withColumn("_p_std", F.stddev_samp(pc).over(whole)))
        return _finish(out, base, group, lagged, fixed, carried=False)
    rows = rows.withColumn("_pc_in", pc_in)

    # --- one row per (sender, bucket) -------------------------------------------------
    last_vals = F.struct(*[F.col(c).alias(c) for c in lagged])
    buckets = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(last_vals, ord_struct).alias("_last"),
        F.min_by(F.struct(F.col("posx").alias("posx"), F.col("posy").alias("posy")), ord_struct).alias("_first"),
        F.count("_speed").alias("_sn"), F.avg("_speed").alias("_sm"),
        (F.var_pop("_speed") * F.count("_speed")).alias("_s2"),
        F.count("_pc_in").alias("_pn"), F.avg("_pc_in").alias("_pm"),
        (F.var_pop("_pc_in") * F.count("_pc_in")).alias("_p2"),
    )
    wt = Window.partitionBy("_g", "_gn").orderBy("_b")
    wall = Window.partitionBy("_g", "_gn")
    buckets = (buckets
               .withColumn("_off", F.coalesce(F.sum("_n").over(wt.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0)))
               .withColumn("_prev", F.lag("_last").over(wt)))
    # Position change of the bucket's first row, against the previous bucket's last row.
    first_pc = F.when(F.col("_prev").isNull(), d(0)).otherwise(_hyp(
        F.coalesce(F.col("_first.posx") - F.col("_prev.posx"), d(0)),
        F.coalesce(F.col("_first.posy") - F.col("_prev.posy"), d(0))))
    # Fold that one value into the bucket's (n, mean, M2).
    pn = F.col("_pn") + 1
    pm_old = F.coalesce(F.col("_pm"), d(0))
    pm_new = pm_old + (F.col("_x") - pm_old) / pn
    buckets = (buckets.withColumn("_x", first_pc)
               .withColumn("_pm2", pm_new)
               .withColumn("_p22", F.coalesce(F.col("_p2"), d(0)) + (F.col("_x") - pm_old) * (F.col("_x") - pm_new))
               .withColumn("_pn2", pn))

    def _sender_std(n: str, m: str, m2: str, name: str) -> list[tuple[str, Column]]:
        tot = F.sum(n).over(wall)
        mean = F.try_divide(F.sum(F.col(n) * F.coalesce(F.col(m), d(0))).over(wall), tot)
        return [(f"{name}_N", tot), (f"{name}_M", mean)]

    for k, v in _sender_std("_sn", "_sm", "_s2", "_s") + _sender_std("_pn2", "_pm2", "_p22", "_p"):
        buckets = buckets.withColumn(k, v)
    for pref, n, m, m2 in (("_s", "_sn", "_sm", "_s2"), ("_p", "_pn2", "_pm2", "_p22")):
        dev = F.coalesce(F.col(m) - F.col(f"{pref}_M"), d(0))
        m2_tot = F.sum(F.coalesce(F.col(m2), d(0)) + F.col(n) * dev * dev).over(wall)
        std = F.when(F.col(f"{pref}_N") > 1, F.sqrt(F.greatest(m2_tot, d(0)) / (F.col(f"{pref}_N") - 1)))
        buckets = buckets.withColumn(f"{pref}_std", std)
    carry = buckets.select(*keys, "_off", "_prev", F.col("_s_std"), F.col("_p_std"))

    # --- back to the rows ----------------------------------------------------------------
    return _finish(rows.join(carry, keys, "inner"), base, group, lagged, fixed, carried=True)


def _finish(out: DataFrame, base: list[str], group: str, lagged: list[str], fixed: bool, carried: bool) -> DataFrame:
    """The 17 features from rows with ``_rn``, ``_off``, ``_speed``, the stds and the lagged values (of the row
    before in the same part; ``carried``: of the part before in ``_prev``)."""
    no_sender = F.col(group).isNull()
    first = F.col("_rn") == 1

    def prev(c: str) -> Column:
        return F.when(first, F.col(f"_prev.{c}")).otherwise(F.col(f"_l_{c}")) if carried else F.col(f"_l_{c}")

    seq = (F.col("_off") + F.col("_rn") - 1).cast("long")
    feats: dict[str, Column] = {}
    feats["sender_sequence"] = F.when(no_sender, F.lit(0).cast("long")).otherwise(seq)
    # The difference of consecutive positions is 1 by construction; the first is filled with 1.
    feats["inter_arrival_time"] = d(1)
    feats["speed_magnitude"] = F.col("_speed")
    for c, name in _DIFFS:
        feats[name] = F.when(no_sender, d(0)).otherwise(F.coalesce(F.col(c) - prev(c), d(0)))
    feats["acceleration_magnitude"] = _hyp(F.col("acceleration_x"), F.col("acceleration_y"))
    feats["position_change_magnitude"] = _hyp(F.col("position_change_x"), F.col("position_change_y"))
    feats["heading_magnitude"] = _hyp(F.col("hedx_n"), F.col("hedy"))
    feats["speed_consistency"] = F.when(no_sender, d(0)).otherwise(F.coalesce(F.col("_s_std"), d(0)))
    feats["position_consistency"] = F.when(no_sender, d(0)).otherwise(F.coalesce(F.col("_p_std"), d(0)))
    feats["hour"] = F.pmod(F.col("sender_sequence"), F.lit(24)).cast("long")
    if fixed:
        feats["night_hours"] = ((F.col("hour") >= 22) | (F.col("hour") < 5)).cast("int")
        feats["inter_arrival_seconds"] = F.when(no_sender, d(0)).otherwise(
            F.coalesce(F.col("sendtime") - prev("sendtime"), d(0)))
    else:
        # An interval from 22 up to 5 is empty, so the flag is always 0.
        feats["night_hours"] = F.lit(0).cast("int")
    feats["speed_position_interaction"] = F.col("speed_magnitude") * F.col("position_change_magnitude")
    feats["inter_arrival_speed_ratio"] = F.col("inter_arrival_time") / (F.col("speed_magnitude") + d(1e-6))

    # Evaluate in dependency order (later features read earlier ones).
    for name, expr in feats.items():
        out = out.withColumn(name, expr)
    # Final fill: every remaining missing value of an engineered feature becomes 0.
    fill = {n: 0.0 for n, e in feats.items() if n not in ("sender_sequence", "hour", "night_hours")}
    out = out.fillna(fill)
    return out.select(*base, *feats.keys())


def sender_consistency(feats: DataFrame, group: str = "senderpseudo") -> DataFrame:
    """Per-sender summary: message count and the two consistency stds."""
    return feats.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.max("speed_consistency").alias("speed_consistency"),
        F.max("position_consistency").alias("position_consistency"),
    )
