"""Contiguous shards of nearly equal bytes from global prefix sums.

The rows are put in key order over range partitions; one total for each partition gives every
partition its global offset, and a running sum inside the partition gives every row its place on the
byte line ``[0, total)``.  The line is cut at equal targets: a row belongs to the shard that holds the
middle of its bytes, so shards are contiguous in key order and differ from the target by at most one
row's size.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, laid_out


def byte_size(text: str = "text", overhead: int = 8) -> Column:
    """UTF-8 bytes of a text (null: none) plus a fixed ``overhead`` for each row."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(overhead)


def byte_shards(df: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 inside the shard) to ``df``.

    ``order`` gives the order in which rows are laid out (ties and nulls allowed: nulls first, tied
    rows in any fixed order), ``size`` a positive long.  Empty input gives empty output; a shard
    may stay empty when single rows are larger than the target.  A row larger than the target takes a
    shard of its own middle.  Columns of ``df`` named ``shard`` or ``slot`` are replaced, others with a
    leading ``_`` are left out.
    """
    df = df.drop("shard", "slot", *[c for c in df.columns if c.startswith("_")])
    laid = laid_out(df, order, "shards")
    total = laid.agg(F.sum(size)).first()[0] or 1
    rows = before(laid, {"_start": F.col(size), "_row": F.lit(1)}, [])
    # exact integers: decimals keep bytes * shards from overflowing
    cut = F.expr(f"cast(_start * 2 + `{size}` as decimal(30,0)) * {n_shards} div cast({2 * total} as decimal(30,0))")
    rows = rows.withColumn("shard", F.least(F.lit(n_shards - 1), cut.cast("int")))
    first = rows.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows at most
    return (rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first"))
            .select(*df.columns, "shard", "slot"))
