"""Chat formatting with collapse of cumulative snapshots.

Chat services log a conversation again after every turn, so a log holds many conversations that are
prefixes of longer ones.  Each turn gets the rolling hash of its conversation up to it.  A
conversation whose last (length, hash) also occurs as a proper prefix of another one is dropped by an
anti-join, equal conversations keep the smallest id, and only the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, laid_out, pin

#: The template's fixed strings.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    """64 bits of a turn and its position; null and empty differ."""
    return F.xxhash64(F.lit(seed), F.col("position"), F.col("role").isNull(), F.coalesce("role", F.lit("")),
                      F.col("text").isNull(), F.coalesce("text", F.lit("")))


def rolling_prefixes(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns with ``position`` (from 0), and ``h1`` to ``h4``, the rolling hash of the turns up to and with this one.

    The hash of a prefix is the sum of position-bound turn hashes (two seeds of 64 bits, summed in
    32-bit halves so that no sum overflows): a running total, so one conversation may span many
    partitions.  Turns with equal ``order`` are ordered by role, then text; null order comes first.
    Rows with a null conversation id form one conversation.
    """
    x = turns.select(F.col(conv).alias("conv_id"), F.col(order).alias("turn"),
                     F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    x = laid_out(x, ["conv_id", "turn", "role", "text"], "turns")
    x = before(x, {"position": F.lit(1)}, ["conv_id"])
    halves = {}
    for seed in (1, 2):
        h = _turn_hash(seed)
        halves[f"h{2 * seed - 1}"] = F.shiftrightunsigned(h, 32)
        halves[f"h{2 * seed}"] = h.bitwiseAND(F.lit(0xFFFFFFFF))
    for k, v in halves.items():
        x = x.withColumn(f"_own_{k}", v)
    y = before(x, {k: F.col(f"_own_{k}") for k in halves}, ["conv_id"])
    return y.select("conv_id", "turn", "role", "text", "position", "_pid", "_mid",
                    *[(F.col(k) + F.col(f"_own_{k}")).alias(k) for k in halves])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``conv_id``, ``n_turns``, ``n_logs`` (equal logs it stands for)."""
    key = ["position", "h1", "h2", "h3", "h4"]
    length = prefixes.groupBy("conv_id").agg(F.max("position").alias("_last"))
    ends = prefixes.alias("p").join(length.alias("l"), F.expr("p.conv_id <=> l.conv_id")).select("p.conv_id", *key, "_last")
    proper = ends.where(F.col("position") < F.col("_last")).select(*key).distinct()
    full = (ends.where(F.col("position") == F.col("_last")).groupBy(*key)
            .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logs")))
    return full.join(proper, key, "left_anti").select("conv_id", (F.col("position") + 1).alias("n_turns"), "n_logs")


def format_chats(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Render the maximal conversations, one row per turn.

    Returns ``conv_id, position, n_turns, n_logs, segment, start``: the rendering of a conversation is
    its segments in order, ``start`` is the segment's first code point in it.  Kept turn by turn, as
    one conversation may be longer than a row can hold.  A null role is rendered as ``unknown``, a
    null text as empty.  Other columns of ``turns`` are ignored.  No turns: no rows.
    """
    p = pin(rolling_prefixes(turns, conv, order), "prefixes")
    keep = maximal_conversations(p)
    segment = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("unknown")), F.lit("\n"),
                       F.coalesce("text", F.lit("")), F.lit(TURN_END))
    x = p.select("conv_id", "position", "_pid", "_mid", segment.alias("segment"))
    x = before(x, {"start": F.char_length("segment")}, ["conv_id"])
    return x.alias("x").join(keep.alias("k"), F.expr("x.conv_id <=> k.conv_id")).select(
        "x.conv_id", "position", "n_turns", "n_logs", "segment", "start")
