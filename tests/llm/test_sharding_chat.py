"""Shards and chat formatting against plain Python."""

import zlib

from pyspark.sql import functions as F

from beaconflow.llm import chat, sharding
from beaconflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_shards(rows, n):
    rows = sorted(rows)
    total, at, out, slots = sum(s for _, s in rows), 0, {}, {}
    for k, s in rows:
        shard = min(n - 1, (2 * at + s) * n // (2 * total))
        out[k] = (shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        at += s
    return out


def test_shard_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_shards([(d.doc_id, len((d.text or "").encode()) + 8) for d in docs], 24)
    got = QUERIES["op9_byte_shards"](spark, SF).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want and len(got) == len(docs)
    crc = {d.doc_id: zlib.crc32((d.text or "").encode()) for d in docs}
    assert all(r.text_crc32 == crc[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in got)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)


def test_shards_of_odd_rows(spark):
    rows = [(i % 7 if i % 5 else None, None if i % 3 else "é" * i) for i in range(60)] + [(3, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", sharding.byte_size())
    got = sharding.byte_shards(df.repartition(5), 4, ["doc_id", "size"]).collect()
    assert len(got) == 61
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.byte_shards(df.limit(0), 4, ["doc_id"]).collect() == []
    odd = df.withColumn("slot", F.lit("x")).withColumn("_pid", F.lit(1))
    assert {(r.doc_id, r.size, r.shard, r.slot) for r in sharding.byte_shards(odd, 4, ["doc_id", "size"]).collect()} == {
        (r.doc_id, r.size, r.shard, r.slot) for r in sharding.byte_shards(df, 4, ["doc_id", "size"]).collect()}


def brute_chat(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    seq = {c: tuple(v[2:] for v in sorted(turns)) for c, turns in convs.items()}
    out = {}
    for c, s in seq.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seq.values()):
            continue
        same = [k for k in seq if seq[k] == s]
        if min(same, key=lambda k: (k is not None, k or 0)) == c or (None in same and c == min(k for k in same if k is not None)):
            out[c] = (len(same), "".join(f"<|im_start|>{r if a else 'unknown'}\n{x}<|im_end|>\n" for a, r, _, x in s))
    return out


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.position):
        n, text = out.get(r.conv_id, (r.n_logs, ""))
        assert r.start == len(text)
        out[r.conv_id] = (n, text + r.segment)
    return out


def test_snapshots_collapse(spark):
    base = [("user", "hi"), ("assistant", "hé"), ("user", None), (None, "")]
    rows = []
    for c, n in enumerate([1, 2, 3, 4, 4, 2, 1]):
        rows += [(c, i * 3, *base[i]) for i in range(n)]  # gaps in turn numbers do not matter
    rows += [(20, 0, "user", "hi"), (20, 1, "assistant", "other"), (21, None, "user", ""), (None, 0, "user", "own")]
    rows += [(30, 0, "user", "hi"), (30, 0, "user", "hi")]  # the same turn twice
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x"))
    assert rendered(chat.format_chats(df.repartition(3))) == brute_chat(rows)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, i, "user", f"t{i}") for i in range(900)] + [(8, i, "user", f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    p = chat.rolling_prefixes(df)
    assert p.where("conv_id = 7").select("_pid").distinct().count() > 1
    got = rendered(chat.format_chats(df))
    assert got == brute_chat(rows) and set(got) == {7}
