"""Language ids by held-out accuracy; quality statistics against plain Python, rules by held-out labels."""

import re
import zlib

import numpy as np

from beaconflow.llm import langid, quality
from beaconflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_query_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_language_id"](spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.95


def test_language_of_odd_texts(spark):
    rows = [(i, "the and of that " * 20, "en") for i in range(30)] + [(100 + i, "der die und das " * 20, "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !!", None), (None, "und das", None), (200, "of that", None),
             (203, "the and of that " * 20000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = langid.predict(df, langid.learn(df)).collect()
    assert len(got) == len(rows)
    by = sorted(((r.doc_id if r.doc_id is not None else -1, r.lang_pred) for r in got))
    assert (-1, "de") in by and (201, "und") in by and (202, "und") in by and (203, "en") in by
    assert [p for k, p in by if k == 200] == ["en", "und"]
    assert langid.learn(df.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), None).collect() == []


def test_windows_cover_the_whole_text():
    net = langid.train(["the and of that " * 10] * 20 + ["der die und das " * 10] * 20, ["en"] * 20 + ["de"] * 20)
    x = np.frombuffer(("the and of that " * 64 + "   ").encode(), np.uint8)
    assert net.windows(x, net.pairs()).shape == (4, 2)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    again = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again))


ODD = [None, "", "   \n\n", "a", "a b c d e a b c d e", "é é é é é é é", "x\nx\n x\n\n\nx", "#*$ %&|<> é#", "w " * 5000, "a b\x1cc d\x0be", "l\r\nl\r\nl"]


def test_statistics_of_odd_texts(spark):
    for t in ODD:
        assert quality.text_statistics(t)[:5] == brute_counts(t), t
    df = spark.createDataFrame([(None if i == 1 else i % 4, t, 0) for i, t in enumerate(ODD)], "doc_id long, text string, n_words int")
    got = sorted(tuple(r)[:6] for r in quality.statistics(df).na.fill(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if i == 1 else i % 4, *brute_counts(t)) for i, t in enumerate(ODD))
    none = df.limit(0)
    assert quality.learn(quality.statistics(none), spark.createDataFrame([], "doc_id long, quality int")) == []


def test_quality_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    assert len(got) == len(docs)
    for k, r in got.items():
        want = brute_counts(docs[k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.rule == 0)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[k].rule == 0 for k, q in labels.items() if q == 1 and k in got]
    bad = [got[k].kept for k, q in labels.items() if q == 0 and k in got]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.15


def test_rules_generalise():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    bad = ((x[:, 2] > 0.7) & (x[:, 5] < 0.5)) | (x[:, 8] > 0.9)
    rules = quality.learn_rules(x, bad)
    y = rng.random((4000, len(quality.FEATURES)))
    want = ((y[:, 2] > 0.7) & (y[:, 5] < 0.5)) | (y[:, 8] > 0.9)
    hit = np.zeros(len(y), bool)
    for r in rules:
        hit |= quality.covers(r, y)
    assert (hit == want).mean() > 0.95
    assert quality.learn_rules(x, np.zeros(len(x), bool)) == []
