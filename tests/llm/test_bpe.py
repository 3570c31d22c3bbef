"""Ids and texts equal those of the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from beaconflow.llm import bpe
from beaconflow.llm.queries import QUERIES
from beaconflow.llm.tokens import encoder

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text, path=PATH):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_query(spark):
    slow = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_bpe_encode_decode"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = slow.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = slow.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


ODD = ["", "a", "é" * 3000, "x" * 30000, " " * 9000, "ab \n\n  c" * 500, "<|endoftext|>" * 40, "one <|endoftext|> two<|endoft",
       "don't we'll 's 　 x  y", "日本語テキスト" * 700, "😀" * 2500 + " z", "\x00\x1c\x85 q"]


def test_any_cut_is_repaired():
    rng, enc, slow = random.Random(4), encoder(PATH), Tokenizer.from_file(PATH)
    words = ["the ", "naïve", " café", "  ", "\n", "'s", "123", "!!", "<|endoftext|>", "日本", "x" * 50, "　", "  a", "don't "]
    for _ in range(300):
        t = "".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        cuts = sorted({0, len(t), *[rng.randint(0, len(t)) for _ in range(rng.randint(0, 6))]})
        known, at = [], 0
        for s, e in zip(cuts, cuts[1:]):
            n = len(t[s:e].encode())
            if rng.random() < 0.6:
                known.append((at, at + n, enc.encode(t[s:e])))
            at += n
        assert bpe.encode_with(enc, t.encode(), known).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_odd_texts_copies_and_shared_passages(spark):
    passage = "".join(f"word{i * i % 977} naïve text, " for i in range(400))
    rows = list(enumerate(ODD)) + [(None, None), (None, "a"), (3, "again")]
    rows += [(100 + i, passage) for i in range(20)] + [(200 + i, f"own{i} " * i + passage + f" tail{i}") for i in range(20)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string").repartition(5)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted([(r.doc_id, r.ids) for r in bpe.encode(df, PATH).collect()], key=key)
    assert got == sorted([(k, plain(t)) for k, t in rows], key=key)
    x = df.selectExpr("doc_id as k", "coalesce(text, '') as text").selectExpr("k", "xxhash64(1, text) as t1", "xxhash64(2, text) as t2", "text")
    texts, place, owners = bpe.shared_chunks(x)
    assert texts.count() == len({t or "" for _, t in rows}) and place.groupBy("c1", "c2").count().where("count > 15").count() > 3
    assert owners.count() >= 1 and owners.selectExpr("sum(size(todo))").first()[0] < place.count() / 4
    assert bpe.encode(df.limit(0), PATH).collect() == []
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t in rows)


def test_decoding_broken_ids(spark):
    slow, enc = Tokenizer.from_file(PATH), encoder(PATH)
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = rng.integers(0, 300, rng.integers(0, 30))
        assert enc.decode(ids) == slow.decode(ids.tolist(), skip_special_tokens=False)
    df = spark.createDataFrame([(1, None), (2, []), (3, [50256, 64])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).orderBy("doc_id").collect()] == [None, "", "<|endoftext|>a"]


def test_other_tokenizer_files_go_through_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert not encoder(path).exact
    df = spark.createDataFrame([(1, "Some text, here"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bpe.encode(df, path).collect()} == {1: plain("Some text, here", path), 2: []}


@pytest.mark.parametrize("text", ODD)
def test_chunks_cover_the_text(text):
    b = text.encode()
    edges = bpe.chunk_edges(b)
    assert edges[0] == 0 and edges[-1] == len(b) and edges == sorted(edges)
    for s, e in zip(edges, edges[1:]):
        b[s:e].decode()
