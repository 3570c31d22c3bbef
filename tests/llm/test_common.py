"""Running totals and samples."""

from pyspark.sql import functions as F

from beaconflow.llm import common


def test_sample_takes_the_smallest_hashes(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    all_ = sorted((r.h, r.id) for r in df.select("id", F.expr(f"pmod(xxhash64(id, 29), {common.HASH_RANGE})").alias("h")).collect())
    for n in (10, 700, 6000):
        got = common.hashed_sample(df.repartition(7), n, ["id"])
        assert got.columns == ["id", "v"] and {r.id for r in got.collect()} == {i for _, i in all_[:n]}
    assert common.hashed_sample(df.limit(0), 5, ["id"]).collect() == []


def test_totals_before_a_row(spark):
    rows = [(g, i, i % 5) for g in (None, 1, 2) for i in range(400)] + [(3, 0, 9)]
    laid = common.laid_out(spark.createDataFrame(rows, "g long, i long, w long").repartition(5), ["g", "i"], "t")
    got = {(r.g, r.i): (r.n, r.s) for r in common.before(laid, {"n": F.lit(1), "s": F.col("w")}, ["g"]).collect()}
    assert got == {(g, i): (i, sum(k % 5 for k in range(i))) if g != 3 else (0, 0) for g, i, _ in rows}
