import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconflow.functions.ranking import rank_within
from beaconflow.operators import evaluate as E
from beaconflow.operators import labels as L
from beaconflow.operators import profile as P
from beaconflow.operators import scaling as Z
from beaconflow.operators import splits as X
from beaconflow.schema import MESSAGE_29
from beaconflow.sources.messages import load_messages, parse_records
from conftest import SF_MID, SF_SMALL, rows

INF = float("inf")
NAN = float("nan")


def _edge_cols(spark):
    data = [(1.0, None, 5.0, NAN, INF), (1.0, None, None, 1.0, -INF), (1.0, None, 5.0, 2.0, 3.0)]
    return spark.createDataFrame(data, "const double, allnull double, const_null double, with_nan double, with_inf double")


def test_missing_inf_distinct_zero_variance(spark):
    df = _edge_cols(spark)
    miss = {r["feature"]: r["n_missing"] for r in P.profile_missing(df).collect()}
    assert miss == {"const": 0, "allnull": 3, "const_null": 1, "with_nan": 1, "with_inf": 0}
    inf = {r["feature"]: r["n_inf"] for r in P.profile_inf(df).collect()}
    assert inf["with_inf"] == 2 and inf["const"] == 0
    dist = {r["feature"]: r["n_distinct"] for r in P.distinct_counts(df).collect()}
    assert dist["allnull"] == 0 and dist["const_null"] == 1 and dist["with_nan"] == 2
    zv = {r["feature"] for r in P.zero_variance(df).collect()}
    assert zv == {"const", "const_null"}  # all-missing column is kept
    assert "allnull" in P.drop_zero_variance(df).columns


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "x int, y string")
    r = P.profile_duplicates(df).first()
    assert r["n_duplicates"] == 2 and r["n_duplicated_groups"] == 1


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0), (None, 1.0, 5.0)],
                               "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in P.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] is None
    x, y = np.array([1.0, 2.0, 3.0]), np.array([2.0, 4.1, 5.9])
    assert abs(got[("a", "b")] - np.corrcoef(x, y)[0, 1]) < 1e-12


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=301).round(2).tolist() + [0.5] * 40
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = {r["p"]: r["value"] for r in P.exact_quantiles(df, ["v"], [0.25, 0.5, 0.75]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert abs(got[p] - np.percentile(vals, p * 100)) < 1e-12


def test_correlation_with_nan_null_and_large_offsets(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + np.array([1.7e9, 0, -50, 3])
    data = [[float(v) for v in row] for row in x]
    for i in range(0, 400, 7):
        data[i][i % 4] = None if i % 2 else NAN
    cols = ["a", "b", "c", "d"]
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in P.correlation_matrix(spark.createDataFrame(data, "a double, b double, c double, d double"), cols).collect()}
    y = np.array([[NAN if v is None else v for v in row] for row in data])
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i:], i):
            both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
            assert abs(got[(a, b)] - np.corrcoef(y[both, i], y[both, j])[0, 1]) < 1e-9


def test_large_integers_keep_apart(spark):
    df = spark.createDataFrame([(2 ** 53 + i,) for i in range(4)], "id long")
    assert P.distinct_counts(df).first()["n_distinct"] == 4
    row = [str(v) for v in [4, 1.5, 7, 71, 9007199254740993] + [0.5] * 24]
    good, _ = parse_records(spark.createDataFrame([(",".join(row),)], "record string"))
    assert good.first()["messageid"] == 9007199254740993 and good.first()["type"] == 4
    good, rejects = parse_records(spark.createDataFrame([(",".join(["4.0"] + row[1:]),), (",".join(["4.5"] + row[1:]),)], "record string"))
    assert good.count() == 1 and rejects.count() == 1


def test_percentages_of_large_totals(spark):
    from decimal import ROUND_HALF_UP, Decimal
    from beaconflow.functions.columns import pct
    rng = np.random.default_rng(2)
    data = [(int(n), int(t)) for t in rng.integers(10 ** 12, 10 ** 14, 3000) for n in [rng.integers(0, t)]]
    got = spark.createDataFrame(data, "n long, t long").select("n", "t", pct("n", "t").alias("p")).collect()
    assert all(r.p == float((Decimal(r.n) * 100 / r.t).quantize(Decimal("0.01"), ROUND_HALF_UP)) for r in got)


def test_contract_refuses_a_repeated_column(spark):
    from beaconflow.sources.messages import check_contract
    df = load_messages(spark, SF_SMALL).select(*MESSAGE_29)
    assert check_contract(df) is df
    with pytest.raises(ValueError):
        check_contract(df.select("*", "posx"))


def test_rows_without_label_or_prediction_are_not_judged(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (None, 0), (1, None)], "label int, prediction int")
    r = E.scores(df).first()
    assert (r["n"], r["macro_f1"], r["accuracy"]) == (2, 1.0, 1.0)


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(0, 3)), [round(float(v), 1) for v in rng.random(3)]) for _ in range(300)] + [(None, [0.1, 0.2, 0.3])]
    got = {r["class"]: r["auc"] for r in E.auc_one_vs_rest(spark.createDataFrame(data, "label int, probability array<double>")).collect()}
    want = []
    for k in range(3):
        pos = [p[k] for c, p in data if c == k]
        neg = [p[k] for c, p in data if c is not None and c != k]
        want.append(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
        assert abs(got[str(k)] - want[-1]) < 1e-12
    assert abs(got["mean"] - sum(want) / 3) < 1e-12


def test_rows_without_a_class_are_split_and_sampled_as_a_class(spark):
    m = load_messages(spark, SF_SMALL).select("row_id", F.when(F.col("row_id") % 2 == 0, F.col("class") % 3).alias("class"))
    n = m.where("class is null").count()
    s = {r["split"]: r["n"] for r in X.stratified_split(m).where("class is null").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert s == {"test": int(0.2 * n), "val": int(0.2 * (n - int(0.2 * n))), "train": n - int(0.2 * n) - int(0.2 * (n - int(0.2 * n)))}
    assert X.stratified_sample(m, rate=0.2).where("class is null").count() == int(0.2 * n)
    r = rank_within(m, ["class"], ["row_id"], num_partitions=3)
    assert sorted(x["_rank"] for x in r.where("class is null").collect()) == list(range(n))


def test_pairs_of_many_files_keep_their_order(spark, tmp_path):
    from beaconflow.sources.messages import read_xy
    import csv
    n, parts = 4000, (50, 2900, 300, 750)  # sizes that task packing would reorder
    for name, value in (("x", lambda i: i), ("y", lambda i: i % 13)):
        at = 0
        (tmp_path / name).mkdir()
        for k, size in enumerate(parts):
            with open(tmp_path / name / f"part-{k}.csv", "w", newline="") as f:
                w = csv.writer(f)
                w.writerow(["v"])
                w.writerows([[value(i)] for i in range(at, at + size)])
            at += size
    got = read_xy(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    assert got.count() == n and got.where("v % 13 <> class or v <> row_index").count() == 0


def test_describe_approx_close(spark):
    m = load_messages(spark, SF_SMALL)
    ex = {r["feature"]: r for r in P.profile_describe(m, ["posx", "spdy"]).collect()}
    ap = {r["feature"]: r for r in P.profile_describe(m, ["posx", "spdy"], exact=False).collect()}
    for c in ("posx", "spdy"):
        assert ex[c]["count"] == ap[c]["count"] and abs(ex[c]["q50"] - ap[c]["q50"]) < 0.5


def test_rank_within_matches_row_number(spark):
    from pyspark.sql import Window
    m = load_messages(spark, SF_SMALL).select("row_id", "class", "posx")
    r = rank_within(m, ["class"], ["posx", "row_id"], num_partitions=5)
    w = Window.partitionBy("class").orderBy("posx", "row_id")
    ref = m.withColumn("_rank", F.row_number().over(w) - 1)
    assert rows(r, ["row_id", "_rank"]) == rows(ref, ["row_id", "_rank"])


def test_regroup_and_names(spark):
    df = spark.createDataFrame([(0,), (13,), (19,), (20,)], "class int")
    got = [r["class_group"] for r in L.regroup(df).orderBy("class").collect()]
    assert got == [0, 4, 5, None]
    with pytest.raises(Exception):
        L.regroup(df, strict=True).collect()
    names = L.with_class_name(spark.createDataFrame([(1,), (9,)], "class_group int")).orderBy("class_group").collect()
    assert names[0]["class_name"] == "Position-related faults" and names[1]["class_name"] == "Class 9"


def test_onehot_tie_first_wins(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 0, 1)], "c0 int, c1 int, c2 int")
    got = [r["class"] for r in L.onehot_decode(df, ["c0", "c1", "c2"]).collect()]
    assert got == [0, 2]


def test_filter_remap_counts(spark):
    df = spark.createDataFrame([(c,) for c in [0, 1, 2, 3, 4, 5, 4]], "class int")
    kept, mapping, counts = L.filter_remap(df, "class", [4, 0, 3, 1])
    assert mapping == {0: 0, 1: 1, 3: 2, 4: 3}
    assert sorted(r["class"] for r in kept.collect()) == [0, 1, 2, 3, 3]
    c = counts.first()
    assert (c["before"], c["after"], c["removed"]) == (7, 5, 2)


def test_select_by_position_coerces(spark):
    df = spark.createDataFrame([("1.5", "x", 3), ("abc", "y", 4)], "a string, b string, c int")
    got = L.select_by_position(df, [0, 2]).collect()
    assert got[0]["a"] == 1.5 and got[1]["a"] is None and got[1]["c"] == 4.0


def test_parse_records(spark):
    good_vals = ",".join(str(float(i)) for i in range(29))
    recs = [(1, good_vals), (2, ",".join(["1"] * 28)), (3, ",".join(["1"] * 30)), (4, good_vals.replace("3.0", "x", 1))]
    df = spark.createDataFrame(recs, "row_id long, record string")
    good, rej = parse_records(df, keep=["row_id"])
    assert [r["row_id"] for r in good.collect()] == [1]
    reasons = {r["row_id"]: r["reason"] for r in rej.collect()}
    assert reasons == {2: "too few values", 3: "too many values", 4: "non-numeric value"}
    assert good.columns == ["row_id"] + MESSAGE_29


def _pairs(spark):
    data = ([(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 1)] * 1 + [(1, 0)] * 2 + [(2, 2)] * 3)
    return spark.createDataFrame(data, "label int, prediction int")


def test_macro_and_weighted_f1(spark):
    s = E.scores(_pairs(spark)).first()
    assert round(s["macro_f1"], 4) == 0.7111 and round(s["weighted_f1"], 4) == 0.75
    assert abs(s["accuracy"] - 12 / 16) < 1e-12
    rep = {r["row"]: r for r in E.classification_report(_pairs(spark)).collect()}
    assert set(rep) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    assert round(rep["macro avg"]["f1"], 4) == 0.7111


def test_macro_f1_invariant_under_renaming(spark):
    df = _pairs(spark)
    ren = df.select(((F.col("label") + 1) * 7).alias("label"), ((F.col("prediction") + 1) * 7).alias("prediction"))
    assert abs(E.scores(df).first()["macro_f1"] - E.scores(ren).first()["macro_f1"]) < 1e-12


def test_class_never_predicted_counts(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 5)], "label int, prediction int")
    pc = {r["label"]: r for r in E.per_class(df).collect()}
    assert set(pc) == {0, 1, 2, 5} and pc[5]["support"] == 0 and pc[1]["f1"] == 0.0


def test_soft_vote_tie_goes_to_first(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], [0.5, 0.5]), (2, [0.2, 0.8], [0.6, 0.4])], "row_id long, a array<double>, b array<double>")
    got = {r["row_id"]: r["prediction"] for r in E.soft_vote(df, ["a", "b"], ["row_id"]).collect()}
    assert got == {1: 0, 2: 1}


def test_gap_bands(spark):
    df = spark.createDataFrame([(g, 0.0) for g in (-0.01, 0.02, 0.05, 0.10)], "cv_accuracy double, test_accuracy double")
    got = [r["band"] for r in E.gap_bands(df).orderBy("gap").collect()]
    assert got == ["excellent", "good", "moderate", "severe"]


def test_holdout_and_folds_are_disjoint_partitions(spark):
    m = load_messages(spark, SF_MID).select("row_id", "senderpseudo")
    h = X.group_holdout(m, ratio=0.8)
    assert L.sender_overlap(h).count() == 0
    n_senders = m.select("senderpseudo").distinct().count()
    n_tv = h.where(F.col("split") == "train_val").select("senderpseudo").distinct().count()
    assert n_tv == int(0.8 * n_senders)
    assert h.count() == m.count()
    f = X.group_kfold(m, k=5)
    assert L.sender_overlap(f, split="fold").count() == 0
    sizes = [r["c"] for r in f.groupBy("fold").agg(F.count(F.lit(1)).alias("c")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 0.1 * max(sizes)
    L.assert_disjoint(h)


def test_stratified_split_shares(spark):
    m = load_messages(spark, SF_MID).select("row_id", "class")
    s = X.stratified_split(m, "class", "row_id")
    c = {(r["class"], r["split"]): r["n"] for r in s.groupBy("class", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0 = sum(v for (k, _), v in c.items() if k == 0)
    nt = math.floor(0.2 * n0)
    assert c[(0, "test")] == nt and c[(0, "val")] == math.floor(0.2 * (n0 - nt))
    assert s.count() == m.count()
    sm = X.stratified_sample(m, "class", 0.2)
    per = {r["class"]: r["n"] for r in sm.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per[0] == math.floor(0.2 * n0)


def test_scaler_and_weights(spark):
    m = load_messages(spark, SF_SMALL)
    cols = ["posx", "spdy", "posz"]
    st = Z.fit_scaler(m, cols)
    chk = {r["feature"]: r for r in Z.scaled_check(Z.apply_scaler(m, st), cols).collect()}
    assert abs(chk["posx"]["mean"]) < 1e-9 and abs(chk["posx"]["std"] - 1) < 1e-9
    assert chk["posz"]["std"] == 0.0  # constant column: divisor 1
    w = Z.class_weights(m, "class", "balanced").collect()
    n = m.count()
    assert abs(sum(r["n_c"] * r["weight"] for r in w) - n) < 1e-6
    ws = Z.class_weights(m, "class", "sqrt").collect()
    assert all(abs(a["weight"] - math.sqrt(b["weight"])) < 1e-12 for a, b in
               zip(sorted(ws, key=lambda r: r["class"]), sorted(w, key=lambda r: r["class"])))
    assert {r["weight"] for r in Z.class_weights(m, "class", None).collect()} == {1.0}


@pytest.mark.parametrize("step,last", [(1, 3), (2, 10_000), (3, 1)])
def test_hash_rank_cutoffs_exact(spark, step, last):
    from beaconflow.functions.ranking import hash_rank_cutoffs
    m = load_messages(spark, SF_SMALL).select("class", F.md5(F.col("row_id").cast("string")).alias("h"))
    local = {}
    for r in m.collect():
        local.setdefault(r["class"], []).append(r["h"])
    targets = [(c, k) for c, hs in local.items() for k in (0, len(hs) // 3, len(hs) - 1, len(hs))]
    t = spark.createDataFrame(targets, "class int, _k long")
    got = {(r["class"], r["_k"]): r["_cut"] for r in hash_rank_cutoffs(m, ["class"], "h", t, step, last).collect()}
    for c, k in targets:
        hs = sorted(local[c])
        assert got[(c, k)] == (hs[k] if k < len(hs) else None)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(size=500).tolist()
    df = spark.createDataFrame([(float(v), 3.0) for v in vals], "a double, c double")
    got = {(r["feature"], r["bin"]): r["n"] for r in P.histogram(df, ["a", "c"], 30).collect()}
    counts, _ = np.histogram(vals, bins=30)
    assert [got.get(("a", i), 0) for i in range(30)] == counts.tolist()
    ccounts, _ = np.histogram([3.0] * 500, bins=30)
    assert [got.get(("c", i), 0) for i in range(30)] == ccounts.tolist()


def test_grouping_sets_distribution(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1)], "split string, class int")
    r = {(x["split"], x["class"], x["level"]): x for x in P.class_distribution_by_split(df).collect()}
    assert r[("b", 1, 0)]["n"] == 2 and r[("b", 1, 0)]["pct_of_split"] == 100.0
    assert r[(None, None, 3)]["n"] == 4 and r[(None, 1, 2)]["pct_of_total"] == 75.0


def test_read_xy_pairs_and_rejects_length_mismatch(spark, tmp_path):
    from beaconflow.sources.messages import read_xy
    from beaconflow.sources.sinks import write_csv
    m = load_messages(spark, SF_SMALL).orderBy("row_id")
    xp, yp, y2 = str(tmp_path / "x"), str(tmp_path / "y"), str(tmp_path / "y2")
    write_csv(m.select("row_id", "posx").coalesce(1), xp)
    write_csv(m.select("class").coalesce(1), yp)
    write_csv(m.select("class").limit(10).coalesce(1), y2)
    got = read_xy(spark, xp, yp)
    ref = m.select(F.col("row_id").cast("double"), "posx", "class")
    assert rows(got.select("row_id", "posx", "class")) == rows(ref)
    with pytest.raises(ValueError):
        read_xy(spark, xp, y2)


def test_export_format(spark):
    from beaconflow.plans.scoring import export_table
    df = spark.createDataFrame([(7, [0.125, 0.875], 1), (3, [0.5, 0.5], 0)],
                               "row_id long, probability array<double>, prediction int")
    got = {r["row"]: r for r in export_table(df).collect()}
    assert got[1]["predicted_class"] == "Class 0" and got[1]["confidence"] == "50.00%"
    assert got[1]["probabilities"] == "0.5000;0.5000"
    assert got[2]["confidence"] == "87.50%" and got[2]["probabilities"] == "0.1250;0.8750"


def test_rate_windows_stream_matches_batch(spark, tmp_path):
    from beaconflow.streaming.features import rate_windows
    m = load_messages(spark, SF_SMALL).withColumn("ts", F.timestamp_seconds("sendtime")).select("ts", "senderpseudo")
    src = str(tmp_path / "src")
    m.write.parquet(src)
    sdf = spark.readStream.schema(m.schema).parquet(src)
    q = (rate_windows(sdf, "ts", "1 hour", watermark="1 hour").writeStream.outputMode("append")
         .format("memory").queryName("rw_test").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination()
    streamed = spark.sql("SELECT * FROM rw_test")
    batch = rate_windows(m, "ts", "1 hour", watermark=None)
    # append mode emits a window once the watermark passes it; the last windows stay open
    last = batch.agg(F.max("window_start")).first()[0]
    assert rows(streamed.where(F.col("window_start") < last - 3600)) == rows(batch.where(F.col("window_start") < last - 3600))


def test_exact_quantiles_of_tied_values(spark):
    # one constant column and one of three values: equal values are counted before they are ranked, so
    # no partition of the ranking holds more rows than there are distinct values
    vals = [1.0] * 5000 + [2.0] * 3 + [float(i) for i in range(100, 160)]
    df = spark.createDataFrame([(v, -v, 7.0, float(i % 3)) for i, v in enumerate(vals)], "a double, b double, c double, d double")
    got = {(r["feature"], r["p"]): r["value"] for r in P.exact_quantiles(df, ["a", "b", "c", "d"], [0.25, 0.5, 0.75]).collect()}
    cols = {"a": vals, "b": [-v for v in vals], "c": [7.0] * len(vals), "d": [float(i % 3) for i in range(len(vals))]}
    for c, v in cols.items():
        for p in (0.25, 0.5, 0.75):
            assert abs(got[(c, p)] - np.percentile(v, p * 100)) < 1e-12
    counted = P._long_values(df, list(cols)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_within(counted, ["feature"], ["value"], weight=F.col("_n"), num_partitions=8)
    n = counted.count()
    assert n == 2 * 62 + 1 + 3 and ranked.count() == n
    assert ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= n


def test_sender_folds_give_the_largest_sender_to_the_lightest_fold(spark):
    def check(df, k):
        got = {r["senderpseudo"]: r["fold"] for r in X.sender_folds(df, k=k).collect()}
        sizes = {}
        for r in df.collect():
            sizes[r["senderpseudo"]] = sizes.get(r["senderpseudo"], 0) + 1
        load = [0] * k
        for s in sorted(sizes, key=lambda s: (-sizes[s], s)):
            f = load.index(min(load))
            assert got[s] == f
            load[f] += sizes[s]
        return load
    check(load_messages(spark, SF_MID).select("senderpseudo"), 4)
    hot = spark.createDataFrame([(1,)] * 400 + [(i,) for i in range(2, 62) for _ in range(10)], "senderpseudo long")
    assert check(hot, 5) == [400, 150, 150, 150, 150]


def test_preparation_job(spark, tmp_path):
    from beaconflow.plans.preparation import run_preparation
    m = load_messages(spark, SF_SMALL)
    raw = m.select(*[F.col(c).alias(c.upper()) for c in m.columns])
    info = run_preparation(raw, str(tmp_path / "out"), profile_path=str(tmp_path / "prof"))
    assert "posz" in info["dropped"] and "type" in info["dropped"] and "posx" in info["scaled"]
    t = spark.read.parquet(str(tmp_path / "out"))
    assert {r["split"] for r in t.select("split").distinct().collect()} == {"train", "val", "test"}
    assert t.count() == m.count() and "posz" not in t.columns
    s = t.where(F.col("split") == "train").agg(F.avg("posx"), F.stddev_pop("posx")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9
    assert spark.read.parquet(str(tmp_path / "prof" / "classes")).count() == 6


def test_empty_splits_and_samples(spark):
    m = load_messages(spark, SF_SMALL).select("row_id", "senderpseudo", "class")
    all_tv = X.group_holdout(m, ratio=1.0)
    assert all_tv.where(F.col("split") == "test").count() == 0 and all_tv.count() == m.count()
    none_tv = X.group_holdout(m, ratio=0.0)
    assert none_tv.where(F.col("split") == "train_val").count() == 0
    assert X.stratified_sample(m, "class", 0.0).count() == 0
    assert X.stratified_sample(m, "class", 1.0).count() == m.count()
    empty = m.where(F.lit(False)).select(F.col("class").alias("label"), F.col("class").alias("prediction"))
    assert E.per_class(empty).count() == 0 and Z.class_weights(m.where(F.lit(False)), "class").count() == 0


def test_duplicate_order_key_with_tiebreak(spark):
    from beaconflow.operators.features import engineer_features
    schema = "t long, k long, senderpseudo long, spdx double, spdy double, posx double, posy double, hedy double, hedx_n double"
    data = [(1, 2, 5, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1, 5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
            (2, 1, 5, 6.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, schema)
    for w in (1.0, 100.0):
        out = {r["k"] * 10 + r["t"]: r for r in engineer_features(df, order="t", tiebreak="k", bucket_width=w).collect()}
        # order (t, k): (1,1) spdx 1 -> (1,2) spdx 3 -> (2,1) spdx 6
        assert [out[11]["sender_sequence"], out[21]["sender_sequence"], out[12]["sender_sequence"]] == [0, 1, 2]
        assert out[21]["acceleration_x"] == 2.0 and out[12]["acceleration_x"] == 3.0
