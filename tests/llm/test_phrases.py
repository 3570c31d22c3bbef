"""Collocations against a plain count of all n-grams."""

import re
from collections import Counter, defaultdict

import numpy as np

from beaconflow.llm import phrases as P

SF = "/root/testdata/sf0.001"


def brute(rows, most=4, least=30, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for m in range(1, most + 1):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i:i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            cuts = [(2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            s, _, l, r = min(cuts)
            scored.append((-s, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.collect()], least=5)
    assert rows(P.collocations(docs, least=5)) == want and len(want) > 100


def test_no_number_of_slots_loses_a_candidate(spark, monkeypatch):
    """With 64k slots for all pairs most windows stay uncut; with many slots most are cut: the same result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = []
    for fewest, most in ((16, 16), (24, 24)):
        monkeypatch.setattr(P, "FEWEST", fewest)
        monkeypatch.setattr(P, "MOST", most)
        got.append(rows(P.collocations(docs, least=8)))
    assert got[0] == got[1] == brute([(r.lang, r.text) for r in docs.collect()], least=8)


ODD = [("en", "New York is new YORK. new york!new\tyork  new york"), ("en", "new york is big, new york is big\nnew york is big"), (None, "new york"),
       ("und", "new york new york"), ("en", None), (None, None), ("en", ""), ("fr", " .,;:!?\n\x0b\x0c\r\t "), ("de", "a a a a a a a a"),
       ("de", "Ä ä \x85x \x85x y \x85x y \x00 \x00 \x00"), ("es", "uno"), ("zh", "你好 你好 你好")]


def test_odd_texts(spark):
    """Nulls, overlaps, ends of pieces, letters beyond A-Z, other white space, repeated rows, clashing columns."""
    data = [(l, t, 1, "x") for l, t in ODD * 2]
    df = spark.createDataFrame(data, "lang string, text string, n int, phrase string").repartition(3)
    assert rows(P.collocations(df, least=2)) == brute([(l, t) for l, t, *_ in data], least=2)
    assert rows(P.collocations(df, least=2, top=2)) == brute([(l, t) for l, t, *_ in data], least=2, top=2)
    assert P.collocations(df.limit(0)).collect() == []
    assert P.collocations(df.where("text is null")).collect() == []


def test_one_very_long_text_and_ties(spark):
    text = " ".join(f"w{i % 97} common pair" for i in range(40_000))
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    assert rows(P.collocations(df)) == brute([("en", text)])


def test_word_ids_and_slots():
    ids, words = P.word_ids(["A b. a", "", "B"])
    assert words == [b"a", b"b"] and ids.tolist() == [0, 1, -1, 0, -1, -1, 1, -1]
    one, two, three = P.part_slots(ids, words, "en", 20, 3)
    assert (one >= 0).tolist() == (ids >= 0).tolist() and (two >= 0).tolist() == [True] + [False] * 7 and (three < 0).all()


def test_other_numbers_of_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    rows_ = [(r.lang, r.text) for r in docs.collect()]
    for most in (2, 5):
        assert rows(P.collocations(docs, least=4, most=most)) == brute(rows_, least=4, most=most)
