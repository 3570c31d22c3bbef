"""Token alignment against a plain reading of the definition with the tokenizer libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from beaconflow.llm import alignment as A
from beaconflow.llm.tokens import byte_letters

SF = "/root/testdata/sf0.001"
BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """The seven columns of each text, and its groups."""
    t = Tokenizer.from_file(BPE)
    t.no_padding()
    t.no_truncation()
    t.encode_special_tokens = True
    sp, letters = sentencepiece.SentencePieceProcessor(model_file=PIECE), byte_letters()
    docs, count = [], Counter()
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        sa = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        sb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(sa) == b"".join(sb) == (" " + text).encode():
            a, b, sa, sb = [], [], [], []
        ends = [[sum(map(len, s[:i + 1])) for i in range(len(s))] if len(s) < 300 else list(__import__("itertools").accumulate(map(len, s))) for s in (sa, sb)]
        both, groups, links = set(ends[0]) & set(ends[1]), [], []
        of = [defaultdict(list), defaultdict(list)]
        cut = sorted(both)
        for side, ids in enumerate((a, b)):
            g = 0
            for i, e in zip(ids, ends[side]):
                while cut[g] < e:
                    g += 1
                of[side][g].append(i)
        groups = [",".join(map(str, of[0][g])) + "|" + ",".join(map(str, of[1][g])) for g in range(len(cut))]
        at = defaultdict(list)
        for i, e in zip(b, ends[1]):
            at[e].append(i)
        links = [(i, j) for i, e in zip(a, ends[0]) for j in at[e]]
        count.update(links)
        docs.append((len(a), len(b), ";".join(groups), len(groups), links))
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [(na, nb, ng, len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls),
             hashlib.sha256(g.encode()).hexdigest() if na else "", g) for na, nb, g, ng, ls in docs]


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.collect()
    want = dict(zip([r.doc_id for r in held], brute([r.text for r in held])))
    got = A.align_tokens(docs.repartition(5), BPE, PIECE, groups=True).collect()
    assert len(got) == len(held) and {r.doc_id: tuple(r[c] for c in [*COLUMNS, "groups"]) for r in got} == want
    assert sum(w[3] for w in want.values()) > 10_000


ODD = [None, "", " ", "a", " a", "a ", "a  b\n\n c\t\td", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café — 你好 😀 😀😀", "▁under▁", "x▁y", "\x00\x01 \x7f",
       "é é ﬁ ﬁ", "tab\tand no-break　wide", "don't WON'T 123456 1 2 3", "same same same", "same same same", "a" * 3000, "​ ﻿", "\n", "ab\r\ncd", "퟿"]


def test_odd_texts(spark):
    """Nulls, white space, special strings as plain text, texts that a side does not give back, repeated and clashing rows."""
    data = [(None if i % 5 == 0 else i % 7, t, "x", 1) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(data, "doc_id int, text string, groups string, n_links int").repartition(2)
    want = sorted(((d[0], *w) for d, w in zip(data, brute(ODD))), key=repr)
    got = sorted(((r.doc_id, *[r[c] for c in [*COLUMNS, "groups"]]) for r in A.align_tokens(df, BPE, PIECE, groups=True).collect()), key=repr)
    assert got == want
    assert any(w[0] == 0 for w, t in zip(brute(ODD), ODD) if t) and A.align_tokens(df.limit(0), BPE, PIECE).collect() == []


def test_a_long_text(spark):
    text = " ".join(f"word{i % 1009} thnterble énoncé{i % 31}" for i in range(60_000))
    want, = brute([text])
    got = A.align_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), BPE, PIECE).first()
    assert tuple(got[c] for c in COLUMNS) == want[:7]
    s = A.sides(BPE, PIECE)
    _, (a,), (b,) = A.faithful([text], s)
    w = A.Windows(a, b, s)
    assert len(w.of) == 180_000 and len(w.texts) < 2_500 and ";".join(w.texts[i] for i in w.of) == want[7]


class Toy:
    """Four ids on both sides, of one, two, three and no bytes; the first of each window is marked."""

    a_bytes = b_bytes = [b"x"] * 8
    a_size = b_size = np.array([1, 2, 3, 0, 1, 2, 3, 0])
    a_marked = b_marked = np.arange(8) >= 4
    shown = [f"{i}{c}" for i in range(8) for c in ",|"] + [f"{i}{c}" for i in range(8) for c in ",;\n"]


def toy(a, b):
    w = A.Windows(np.array(a), np.array(b), Toy())
    ends = np.cumsum(w.n_links)
    return [(w.texts[i], int(w.n_groups[i]), [(c >> 32, c & 0xFFFFFFFF) for c in w.links[ends[i] - w.n_links[i]:ends[i]].tolist()]) for i in w.of]


def test_tokens_that_end_together():
    assert toy([4, 1, 2], [6, 2]) == [("4,1|6;2|2", 2, [(1, 6), (2, 2)])]
    assert toy([6, 3], [4, 1]) == [("6,3|4,1", 1, [(6, 1), (3, 1)])]
    assert toy([4, 5, 0, 4], [4, 5, 0, 4]) == [("4|4", 1, [(4, 4)]), ("5|5;0|0", 2, [(5, 5), (0, 0)]), ("4|4", 1, [(4, 4)])]


def test_windows_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(A, "tuple_hash", lambda ids, starts, sizes: np.zeros(len(starts), np.uint64))
    assert toy([4, 5, 4, 6], [4, 5, 4, 6]) == [("4|4", 1, [(4, 4)]), ("5|5", 1, [(5, 5)]), ("4|4", 1, [(4, 4)]), ("6|6", 1, [(6, 6)])]
    assert toy([4, 5, 0], [4, 5, 0]) == [("4|4", 1, [(4, 4)]), ("5|5;0|0", 2, [(5, 5), (0, 0)])]
