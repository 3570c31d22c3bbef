"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for every node of ``links`` (columns a, b), as a written table.

    Each round hangs every node's neighbours under the smallest one, first those above it, then those
    below; rounds end when nothing changes (a few, about the logarithm of the longest chain).  Minima
    are aggregated before the shuffle and a hub's rows meet one row of the other side in each
    join, so that a node with very many links is split like any skewed join.
    """
    e = pin(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        sign = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == before or not sign[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
        before = sign
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = pin(small.union(low).distinct(), "stars")
