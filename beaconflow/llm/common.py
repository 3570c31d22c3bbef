"""Helpers shared by the operators: written intermediates, running totals over any number of partitions."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Rows that one range partition of a distributed ranking should hold.
ROWS_PER_PARTITION = 1_000_000


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application (as ``spark-submit --py-files`` does)."""
    sc = spark.sparkContext
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.applicationId in _SHIPPED or not os.path.isdir(top):
        return
    _SHIPPED.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "beaconflow_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    sc.addPyFile(path)


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the re-read of a file, never a recomputation that
    might deal rows out differently.
    """
    ship_package(df.sparkSession)
    path = scratch_dir(df.sparkSession, f"llm-{name}")
    # small row groups and pages checked at every row: a column of large blobs is held in small parts only
    (df.write.option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 1)
     .option("parquet.page.size.row.check.max", 100).parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(df: DataFrame) -> DataFrame:
    """``df`` planned once, for several jobs: what its last shuffle wrote is read by each of them (and made again if it is lost)."""
    plan, spark = df._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.queryExecution().toRdd(), plan.schema(), False), spark)


def range_partitions(spark, rows: int) -> int:
    """Range partitions for ``rows`` rows: the session's shuffle partitions, more when those would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION))


def laid_out(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once, with the place of each row.

    Adds ``_pid`` (the range partition) and ``_mid`` (increasing inside it).  All later totals refer to
    this one written layout.
    """
    n = range_partitions(df.sparkSession, df.count())
    cols = [F.col(c) for c in order]
    return pin(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()), name)


def before(laid: DataFrame, values: dict[str, Column], group: list[str]) -> DataFrame:
    """Add, for each entry of ``values``, the sum over the rows that stand before the row in its group.

    ``laid`` comes from ``laid_out`` with an order that starts with ``group``.  A running sum inside
    (group, range partition) plus the totals of the group's earlier partitions: no group is ever
    gathered in one task, however many rows it holds.
    """
    part = laid.groupBy(*group, "_pid").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_pid").alias("_p"),
                       *[F.sum(f"_t_{k}").over(earlier).alias(f"_o_{k}") for k in values])
    # Only groups that span a partition border have an offset: at most one for each border, so at
    # most as many rows as there are range partitions, whatever the input.
    some = next(iter(values))
    part = part.where(F.col(f"_o_{some}").isNotNull())
    inside = Window.partitionBy(*group, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    x = laid.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{k}") for k, v in values.items()])
    cond = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group] + [F.col("_pid") == F.col("_p")]
    x = x.join(F.broadcast(part), cond, "left")
    return x.select(*laid.columns, *[(F.col(f"_i_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0))).alias(k) for k in values])


#: Hashes of a sample are compared as numbers below this.
HASH_RANGE = 1 << 62


def hashed_sample(df: DataFrame, n: int, key: list[Column | str], total: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key`` (all rows if there are fewer).

    With N rows about the 2n smallest hashes lie below 2n / N of the hash range: only those rows
    are looked at further, so what is gathered stays near 2n rows however many tasks the input has.
    """
    total = df.count() if total is None else total
    h = F.pmod(F.xxhash64(*key, F.lit(29)), F.lit(HASH_RANGE))
    below = min(HASH_RANGE, (2 * n + 100) * HASH_RANGE // max(total, 1))
    return df.withColumn("_sampled", h).where(F.col("_sampled") < F.lit(below)).orderBy("_sampled").limit(n).drop("_sampled")
