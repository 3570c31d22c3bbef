"""The pipeline stage by stage against brute force, and odd rows through all of it."""

import re

import numpy as np
import pytest

import corpus_pipeline as P
from beaconflow.llm import quality
from test_minhash import brute
from test_packing import check
from test_secrets import brute as brute_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: tuple(r) for r in df.collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "language_id", "near_dedup", "secret_scan", "best_fit_packing"]
    for df in steps[1:-1]:
        assert sorted(df.columns) == sorted(steps[0].columns)


def test_quality_stage(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert all(before[k] == v for k, v in after.items())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, r in before.items():
        n, _, _, _, again = quality.text_statistics(r[1])[:5]
        if n < 10 or 100 * again > 20 * n:
            assert k not in after
    good = [k in after for k, r in labels.items() if r.quality == 1 and k in before and not
            (lambda s: s[0] < 10 or 100 * s[4] > 20 * s[0])(quality.text_statistics(before[k][1]))]
    assert np.mean(good) > 0.99
    assert np.mean([k in after for k, r in labels.items() if r.quality == 0 and k in before]) < 0.15


def test_language_stage(steps):
    before, after = rows(steps[1]), rows(steps[2])
    assert all(before[k] == v for k, v in after.items())
    lettered = [k for k, r in before.items() if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert set(after) <= set(lettered) and len(after) > 0.99 * len(lettered)


def test_dedup_stage(steps):
    before, after = rows(steps[2]), rows(steps[3])
    assert after == {k: before[k] for k, (_, _, kept) in brute([(k, r[1]) for k, r in before.items()], 5, 80).items() if kept}
    assert len(after) < len(before)


def test_secret_stage(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    names, changed = steps[3].columns, 0
    for k, r in before.items():
        old, new = dict(zip(names, r)), dict(zip(steps[4].columns, after[k]))
        spans = brute_spans(old["text"])
        if not spans:
            assert old == new
            continue
        changed += 1
        assert "[SECRET]" in new["text"] and new["n_chars"] == len(new["text"])
        for s in spans:
            _, a, b = s.split(":")
            assert old["text"][int(a):int(b)] not in new["text"]
    assert changed


def test_packing_stage(steps):
    check(steps[5].collect(), [(k, r[1]) for k, r in rows(steps[4]).items()])


def test_odd_rows_through_all_stages(spark, tmp_path):
    text = " ".join(f"word{i} and more" for i in range(40))
    docs = [(1, text, "en"), (1, text, "en"), (2, text, None), (None, text + " tail", "en"), (None, None, None), (3, None, "en"), (4, "", None),
            (5, "12 34 " * 30, None), (6, " ".join(f"mot{i} encore" for i in range(40)) + " token=abcdefgh", "fr"), (7, "too short", "en")]
    df = spark.createDataFrame([(*d, "src", len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}, key=str) == [1, 6]
    assert len({(r.doc_id, r.piece, r.start, r.ids_crc32) for r in got}) == len(got)


def test_near_dedup_keeps_what_is_no_copy(spark):
    """Rows of one id with different texts, copies under several ids and copies without an id."""
    a, b, c = (" ".join(f"{w}{i} and so on" for i in range(60)) for w in ("one", "two", "three"))
    rows = [(2, a, "x"), (2, b, "x"), (1, a, "x"), (3, b + " more", "x"), (None, c, "x"), (None, c + " end", "x"), (None, a, "x"),
            (4, "", "x"), (4, None, "x"), (5, None, "x"), (6, "alone", "y"), (6, "alone", "x"), (None, None, "x")]
    docs = spark.createDataFrame([(*r, None, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text, r.lang) for r in P.near_dedup(spark, docs.repartition(3), "").collect()), key=repr)
    texts = [t for _, t, _ in got]
    assert (1, a, "x") in got and (2, b, "x") in got and sum(t in (c, c + " end") for t in texts) == 1
    rest = [r for r in got if r[1] not in (a, b, c, c + " end", b + " more")]
    assert rest == sorted([(4, "", "x"), (4, None, "x"), (5, None, "x"), (6, "alone", "x"), (None, None, "x")], key=repr)
    assert len(got) == 8


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
