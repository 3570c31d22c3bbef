"""Near-duplicates against comparing all pairs of shingle sets."""

import random
import re

import numpy as np

from beaconflow.llm import graph, minhash
from beaconflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(docs, n=3, percent=85):
    sets = {k: shingles(t, n) for k, t in docs}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    keys = sorted(sets, key=lambda k: len(sets[k]))
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def test_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op1_minhash_dedup"](spark, SF).collect()
    want = brute(docs)
    assert len(got) == len(docs) and {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert sum(not k for _, _, k in want.values()) > 50


def test_chains_stars_and_odd_texts(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    docs = [(1000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1:])) for i in range(0, 120, 3)]  # near copies of one text
    chain = list(base)
    for i in range(25):  # each close to the next only
        chain[(4 * i) % 120] = f"c{i}"
        docs.append((2000 - i, " ".join(chain)))
    docs += [(5000 + i, "same text over and over again") for i in range(30)]
    docs += [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "word " * 20000)]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, id string").repartition(6)
    for n, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(df, n=n, percent=percent, bands=42, rows=6).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, n, percent)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_members_that_no_star_connects(spark, monkeypatch):
    """Pairs of texts that are close to each other, but not to the hub of their buckets; over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, docs = random.Random(6), []
    base = [f"w{i}" for i in range(150)]
    for i in range(40):
        own = [f"o{i}_{j}" if rng.random() < 0.05 else w for j, w in enumerate(base)]
        docs.append((2 * i, " ".join(own)))
        docs.append((2 * i + 1, " ".join(own[:60] + ["x"] + own[60:])))
    docs.append((999, " ".join(base)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len({c for _, c, _ in want.values()}) > 3


def test_null_and_repeated_keys(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(None, long), (None, long), (7, long), (7, long), (7, "other words here now"), (3, "other words here now"), (9, long)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == sorted(
        [(0, None, True)] * 2 + [(7, 3, False)] * 3 + [(3, 3, True), (9, 3, False)], key=lambda r: (r[0], r[1] or 0))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8):
        same = [f"s{i}" for i in range(int(300 * share))]
        a = minhash.shingle_sets([" ".join(same)], 1)[0]
        b = np.unique(np.concatenate((a, rng.integers(0, 2**63, 300 - len(same)).astype(np.uint64))))
        sig = minhash.signatures([a, b], 252)
        assert abs((sig[0] == sig[1]).mean() - len(a) / len(b)) < 0.12
    one = np.array([5], np.uint64)
    assert (minhash.signatures([one], 252) == 5).all() and sum(b > 0 for b in minhash.digests([one])[0]) == 1


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{k: 500 for k in range(500, 560)}}
