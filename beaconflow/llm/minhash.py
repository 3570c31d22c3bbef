"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's word shingles are hashed once; the hash range is cut into bins and the smallest hash of each bin is
the signature, an empty bin borrows from bins drawn by a hash sequence that all documents share.
Bands of bins are bucket keys.  Inside a bucket candidates form a star: the member that shares most
buckets with others is the hub, and only its pairs are compared.  Links are confirmed on the full shingle sets.
Members that the stars connect need no further look.  What they leave apart is compared exactly too:
in blocks, by signatures, with only pairs that may reach the similarity going on to be confirmed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, mix64, ngrams, word_hashes
from .common import pin
from .graph import components

#: Members of one block of a bucket; bins of a digest; standard deviations by which a digest may understate the similarity.
BLOCK, DIGEST, SLACK = 1024, 512, 4.0


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text, A-Z lowered; fewer words are one shingle, none is empty."""
    words, size = word_hashes([(t or "").encode() for t in texts])
    return [np.unique(ngrams(words[e - k:e], min(n, k))) if k else np.zeros(0, np.uint64) for k, e in zip(size.tolist(), np.cumsum(size).tolist())]


def one_permutation(sets: list[np.ndarray], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash in each bin (sets x bins) of sets that are not empty, and whether the bin holds any."""
    edges = np.arange(bins, dtype=np.uint64) * np.uint64(2 ** 64 // bins)
    sig, full = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = np.append(np.searchsorted(s, edges), len(s))
        full[i] = at[:-1] < at[1:]
        sig[i] = s[np.minimum(at[:-1], len(s) - 1)]
    return sig, full


def digests(sets: list[np.ndarray], bins: int = DIGEST) -> list[bytes]:
    """A byte for each bin, 0 where it is empty: what an estimate of the similarity needs."""
    sig, full = one_permutation(sets, bins)
    return [d.tobytes() for d in np.where(full, sig % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)]


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Densified one-permutation signatures (sets x bins) of sets that are not empty."""
    sig, full = one_permutation(sets, bins)
    rows, cols = np.nonzero(~full)
    attempt = 0
    while len(rows):
        attempt += 1
        j = (mix64(cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[rows, j]
        sig[rows[hit], cols[hit]] = sig[rows[hit], j[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key (sets x bands) for each band of ``rows`` bins."""
    out = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(sig), 1), np.uint64)
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r:bands * rows:rows])
    return out.view(np.int64)


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """From ``k, text``: ``k, n_shingles, s1, s2`` (hash of the whole set; null when empty), ``bands`` and ``digest``."""
    def work(cols: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(cols["text"], n)
        live = [i for i, s in enumerate(sets) if len(s)]
        out = {"k": cols["k"], "n_shingles": [len(s) for s in sets], **{c: [None] * len(sets) for c in ("s1", "s2", "bands", "digest")}}
        if live:
            some = [sets[i] for i in live]
            for i, b, d in zip(live, band_keys(signatures(some, bands * rows), bands, rows), digests(some)):
                h = xxhash.xxh3_128_intdigest(sets[i].tobytes())
                out["s1"][i], out["s2"][i] = (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)
                out["bands"][i], out["digest"][i] = b, d
        return out

    kind = docs.schema["k"].dataType.simpleString()
    return map_texts(docs, work, f"k {kind}, n_shingles long, s1 long, s2 long, bands array<long>, digest binary")


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of ``hub, id`` pairs those whose sets have 100 * intersection >= ``percent`` * union, as ``a, b``."""
    kind = pairs.schema["hub"].dataType.simpleString()
    last: dict = {}

    def work(cols: dict[str, list]) -> dict[str, list]:
        a, b = [], []
        for hub, i, x, two in zip(cols["hub"], cols["id"], cols["x"], shingle_sets(cols["y"], n)):
            if last.get("text") != x:  # rows come sorted by hub
                last.update(text=x, set=shingle_sets([x], n)[0])
            one = last["set"]
            at = np.searchsorted(one, two)
            both = int((one[np.minimum(at, len(one) - 1)] == two).sum()) if len(one) else 0
            if both and 100 * both >= percent * (len(one) + len(two) - both):
                a.append(hub)
                b.append(i)
        return {"a": a, "b": b}

    x = (pairs.join(texts.select(F.col("k").alias("id"), F.col("text").alias("y")), "id")
         .join(texts.select(F.col("k").alias("hub"), F.col("text").alias("x")), "hub").select("hub", "id", "x", "y"))
    return map_texts(x, work, f"a {kind}, b {kind}", ("x", "y"))


def star_pairs(bucket: DataFrame, percent: int) -> DataFrame:
    """``hub, id``: in every bucket the member that shares most buckets with others, against each member.

    A text that many others were made from shares more buckets than they share among themselves, so
    it is the hub that connects most.
    """
    size = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    degree = bucket.join(size, "bucket").groupBy("id").agg(F.sum("size").alias("degree"))
    hub = bucket.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", -F.col("id"), "n")).alias("h")).select(
        "bucket", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hn"))
    # sets whose sizes are too far apart cannot reach the similarity
    near = (F.least("n", "hn") * 100 >= F.greatest("n", "hn") * percent) & (F.col("id") != F.col("hub"))
    return bucket.join(hub, "bucket").where(near).select("hub", "id").distinct()


def likely_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """``hub, id``: pairs of different components in one bucket whose signatures allow the similarity, each once.

    ``open_``: ``bucket, band, id, n, c`` (its component), ``bands``, ``digest``.  The members outside a bucket's
    largest component are compared with all members, blocks of BLOCK against BLOCK, so a bucket of any
    size is spread over tasks, and only pairs that pass come out.  A pair that shares several buckets comes from its
    first band.  The share of equal bins estimates the similarity from bins drawn without replacement; a pair
    passes up to SLACK standard deviations below the bound.
    """
    group = open_.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("m"))
    major = group.groupBy("bucket").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("all")).select(
        "bucket", F.col("top.c").alias("major"), F.ceil(F.col("all") / BLOCK).alias("np"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).alias("nq"))
    x = open_.join(major, "bucket").where("nq > 0").withColumn("rest", F.col("c") != F.col("major"))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    x = x.withColumn("p", at % F.col("np")).withColumn("q", at % F.col("nq"))
    zero = F.lit(0).cast("long")
    cols = ["bucket", "band", "id", "n", "c", "rest", "bands", "digest"]
    every = x.withColumn("q", F.explode(F.sequence(zero, F.col("nq") - 1))).withColumn("left", F.lit(False))
    left = x.where("rest").withColumn("p", F.explode(F.sequence(zero, F.col("np") - 1))).withColumn("left", F.lit(True))
    both = every.select(*cols, "p", "q", "left").unionByName(left.select(*cols, "p", "q", "left"))
    bound = percent / 100

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        u, a = t[t["left"]], t[~t["left"]]
        if not len(u) or not len(a):
            return pd.DataFrame({"hub": [], "id": []}, dtype="int64")
        uid, aid, un, an = u["id"].to_numpy(), a["id"].to_numpy(), u["n"].to_numpy(), a["n"].to_numpy()
        uc, ac, arest = u["c"].to_numpy(), a["c"].to_numpy(), a["rest"].to_numpy()
        ad = np.frombuffer(b"".join(a["digest"]), np.uint8).reshape(len(a), -1)
        ab, band, out = np.array(a["bands"].tolist()), int(t["band"].iloc[0]), ([], [])
        for i in range(len(u)):
            # two members outside the largest component meet from both sides: one is enough
            j = np.flatnonzero((ac != uc[i]) & (~arest | (aid > uid[i])) & (np.minimum(an, un[i]) * 100 >= np.maximum(an, un[i]) * percent))
            if not len(j):
                continue
            d = np.frombuffer(u["digest"].iloc[i], np.uint8)
            same = ((ad[j] == d) & (d > 0)).sum(axis=1)
            seen = np.maximum(((ad[j] > 0) | (d > 0)).sum(axis=1), 1)
            union = np.maximum((an[j] + un[i]) / (1 + bound), 2)
            spread = np.sqrt(bound * (1 - bound) / seen * np.clip(1 - (seen - 1) / (union - 1), 0.05, 1))
            j = j[same / seen >= bound - SLACK * spread]
            j = j[(ab[j] == np.asarray(u["bands"].iloc[i])).argmax(axis=1) == band]
            out[0].append(np.full(len(j), uid[i]))
            out[1].append(aid[j])
        return pd.DataFrame({"hub": np.concatenate(out[0]), "id": np.concatenate(out[1])} if out[0] else {"hub": [], "id": []}, dtype="int64")

    return both.groupBy("bucket", "p", "q").applyInPandas(compare, "hub long, id long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 85,
                    bands: int = 36, rows: int = 7) -> DataFrame:
    """``key, n_shingles, component_id`` (smallest key reachable by links) and ``kept`` (key = component_id) per row.

    Words are runs without blanks and control spaces, A-Z lowered; a null or wordless text has an empty
    set and links with nothing.  Two documents link when 100 * intersection >= ``percent`` * union of
    their sets of ``n``-word shingles.  A pair at exactly 85 % shares none of 36 bands of 7 with a
    probability under 1e-6.  Equal sets are one class, compared once.  Keys are integers; rows with the same key are
    one node; a row without a key is left alone (component_id null, kept).  Other columns are ignored.
    """
    x = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))
    sketch = pin(sketches(x, n, bands, rows), "sketches")
    known = sketch.where("k is not null and s1 is not null")
    classes = pin(known.groupBy("s1", "s2").agg(F.min("k").alias("id"), F.first("n_shingles").alias("n"),
                                                F.first("bands").alias("bands"), F.first("digest").alias("digest")), "classes")
    member = known.select("k", "s1", "s2").join(classes.select("s1", "s2", "id"), ["s1", "s2"])
    # a key with several texts belongs to several classes: one node
    several = member.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("k", "a")
    same = pin(member.join(several, "k").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "same")

    spread = classes.select(F.posexplode("bands").alias("band", "bucket"), "id", "n")
    shared = spread.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    bucket = pin(spread.join(shared, "bucket"), "buckets")
    texts = pin(x.join(bucket.select(F.col("id").alias("k")).distinct(), "k"), "texts")

    stars = pin(star_pairs(bucket, percent), "stars")
    links = pin(same.union(confirmed(stars, texts, n, percent)), "links")
    now = bucket.join(components(links).withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "band", "id", F.coalesce("component", "id").alias("c"))
    apart = now.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    open_ = now.join(apart, "bucket").join(classes.select("id", "n", "bands", "digest"), "id")
    rest = pin(likely_pairs(open_, percent).join(stars, ["hub", "id"], "left_anti").join(
        stars.select(F.col("hub").alias("id"), F.col("id").alias("hub")), ["hub", "id"], "left_anti"), "rest")
    comp = components(links.union(confirmed(rest, texts, n, percent)))

    place = classes.select("s1", "s2", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select(
        "s1", "s2", F.coalesce("component", "id").alias("c"))
    out = sketch.join(place, ["s1", "s2"], "left").select(
        F.col("k").alias(key), "n_shingles", F.when(F.col("k").isNotNull(), F.coalesce("c", "k")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
