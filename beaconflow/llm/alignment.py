"""Alignment of the tokens of two tokenizers over the same text.

Whole texts are tokenised by both.  Places where a token of each side ends and a space-marked token of each side
begins are anchors: the shared ends are verified on byte offsets, and cut a text into windows of token ids.  A window
is aligned once for its id tuples and looked up wherever it comes again.

The corpus-wide counts of linked id pairs come from one sum over blocks of documents (a written row for each block, with
its documents' windows and its pairs); every block then gets the counts of its own pairs back, so no table of all
pairs is held anywhere.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .batches import map_texts, mix64
from .common import pin
from .sums import pack, unpack
from .tokens import byte_letters, encoder


class Sides:
    """Both tokenizers: ids of texts, the bytes of every id, and which tokens are marked by a space."""

    def __init__(self, bpe_path: str, piece_path: str):
        enc = encoder(bpe_path)
        letters = byte_letters()
        with open(bpe_path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["id"]: t["content"] for t in spec.get("added_tokens") or []}
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [b""] * (max([*names, *added]) + 1)
        for i, t in names.items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        for i, t in added.items():
            self.a_bytes[i] = t.encode()
        if enc.exact:
            self.fast: tiktoken.Encoding | None = enc.fast
        else:
            self.fast, self.slow = None, Tokenizer.from_file(bpe_path)
            self.slow.no_padding()
            self.slow.no_truncation()
            self.slow.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = []
        for i in range(self.pieces.vocab_size()):
            p = self.pieces.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as they are written: A before a comma or the bar, B before a comma, a semicolon or the end of a window
        self.shown = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;\n"]
        self.a_marked, self.b_marked = (np.array([t[:1] == b" " for t in x]) for x in (self.a_bytes, self.b_bytes))

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and the text; the strings of special tokens are plain text."""
        if self.fast:
            return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(bpe_path: str, piece_path: str) -> Sides:
    return Sides(bpe_path, piece_path)


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of a flat array: the places they cover, and each place's offset in its stretch."""
    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + offset, offset


def tuple_hash(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of ids."""
    offset = np.arange(len(ids)) - np.repeat(starts, sizes)
    h = mix64(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    return mix64(np.add.reduceat(h, starts) + sizes.astype(np.uint64))


class Windows:
    """The token windows of a run of texts and the alignment of the distinct ones.

    ``a`` and ``b`` are the ids of all texts one after another; both sides cover the same bytes.  A window begins at
    every byte offset where a space-marked token begins on both sides: there the tokens before it end together.
    Windows with equal id tuples share a number (``of``) and are aligned once.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, s: Sides):
        at_a, at_b = np.cumsum(s.a_size[a]) - s.a_size[a], np.cumsum(s.b_size[b]) - s.b_size[b]
        mark_a, mark_b = np.flatnonzero(s.a_marked[a]), np.flatnonzero(s.b_marked[b])
        _, pa_, pb_ = np.intersect1d(at_a[mark_a], at_b[mark_b], assume_unique=True, return_indices=True)
        self.ia, self.ib = mark_a[pa_], mark_b[pb_]
        if not len(self.ia) or self.ia[0] or self.ib[0]:
            self.ia, self.ib = np.append(0, self.ia), np.append(0, self.ib)
        na, nb = np.diff(self.ia, append=len(a)), np.diff(self.ib, append=len(b))
        key = tuple_hash(a, self.ia, na) + tuple_hash(b, self.ib, nb) * np.uint64(3)
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        # the id tuples themselves decide: a window that only shares its hash stands for itself
        like = first[of]
        other = (na != na[like]) | (nb != nb[like])
        if not other.any():
            for ids, starts, sizes in ((a, self.ia, na), (b, self.ib, nb)):
                place, _ = spread(starts[like], sizes)
                other |= np.logical_or.reduceat(ids != ids[place], starts)
        if other.any():
            of[other] = len(first) + np.arange(int(other.sum()))
            first = np.append(first, np.flatnonzero(other))
        self.of = of
        self.align(*[ids[spread(starts[first], sizes[first])[0]] for ids, starts, sizes in ((a, self.ia, na), (b, self.ib, nb))], na[first], nb[first], s)

    def align(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, s: Sides) -> None:
        """Groups, links and texts of the distinct windows, all at once.

        Groups end where tokens of both sides do; tokens whose byte ranges end together are linked, one link for each pair
        of occurrences (tokens without bytes end with the one before them).
        """
        ends_a, ends_b = np.cumsum(s.a_size[a]), np.cumsum(s.b_size[b])
        shared = np.intersect1d(ends_a, ends_b)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        # tokens that end at a shared end, by group: from ... and how many
        from_a, from_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        upto_a, upto_b = np.searchsorted(ends_a, shared, side="right"), np.searchsorted(ends_b, shared, side="right")
        each = (upto_a - from_a) * (upto_b - from_b)
        _, r = spread(np.zeros(len(shared), np.int64), each)
        wide = np.repeat(upto_b - from_b, each)
        self.links = a[np.repeat(from_a, each) + r // wide].astype(np.int64) << 32 | b[np.repeat(from_b, each) + r % wide]
        # a group belongs to the window of its last tokens
        last = np.cumsum(na) - 1
        window = np.searchsorted(last, upto_a - 1)
        self.n_groups = np.bincount(window, minlength=len(na))
        self.n_links = np.bincount(window, weights=each, minlength=len(na)).astype(np.int64)
        # texts: the ids of each group's A, then B, each with the sign that follows it
        kind_a = (np.append(np.diff(group_a), 1) > 0).astype(np.int64)
        kind_b = (np.append(np.diff(group_b), 1) > 0).astype(np.int64)
        kind_b[np.cumsum(nb) - 1] = 2
        count_a, count_b = np.cumsum(np.bincount(group_a, minlength=len(shared))), np.cumsum(np.bincount(group_b, minlength=len(shared)))
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, count_b)[group_a]] = a * np.int64(2) + kind_a
        order[np.arange(len(b)) + count_a[group_b]] = b * np.int64(3) + kind_b + 2 * len(s.a_bytes)
        self.texts = "".join([s.shown[c] for c in order.tolist()]).split("\n")[:-1]


def faithful(texts: list[str | None], s: Sides) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Which texts both sides give back byte by byte, and their ids; null and empty texts are not among them."""
    live = [i for i, t in enumerate(texts) if t]
    some = [texts[i] for i in live]
    out: tuple[list, list, list] = ([], [], [])
    for i, t, a, b in zip(live, some, s.encode_a(some), s.encode_b(some)):
        want = (" " + t).encode()
        # the fast encoder only splits bytes, so those of A are the text's
        if b"".join([s.b_bytes[x] for x in b]) == want and (s.fast or b"".join([s.a_bytes[x] for x in a.tolist()]) == want):
            for o, x in zip(out, (i, a, np.array(b, np.uint32))):
                o.append(x)
    return out


def align_tokens(docs: DataFrame, bpe_path: str, piece_path: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row; with ``groups`` also their text.

    A: space and text by the byte-level BPE file; B: the text by the piece model, which adds the space.  A link is a pair
    of token occurrences whose byte ranges end together; a pair's count is how many links of all rows hold its two ids;
    a link is best when its count is the highest that its B id has (ties included); ``count_sum`` adds the counts of a
    row's links.  Texts that are null or empty, or that either side does not give back byte by byte, have no tokens: all
    zero and ''.  Rows with equal or null keys stay apart; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    x = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("m"))
    shown = ", groups:string" if groups else ""
    made = f"array<struct<k:{kind}, n_a:int, n_b:int, n_groups:int, n_links:int, sha:string, n:int{shown}>>"

    def block(rows: dict[str, list]) -> dict[str, list]:
        """One row for the slice: its documents, the windows of each, and the distinct windows' pairs."""
        s = sides(bpe_path, piece_path)
        out = [{"k": k, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": "", "n": 0} | ({"groups": ""} if groups else {}) for k in rows["k"]]
        sizes, code, of, times = (np.zeros(0, np.int64) for _ in range(4))
        live, a, b = faithful(rows["text"], s)
        if live:
            w = Windows(np.concatenate(a), np.concatenate(b), s)
            sizes, code, of = w.n_links, w.links, w.of
            # a text begins with a window
            ends = np.searchsorted(w.ia, np.cumsum([0, *map(len, a)]))
            for i, x, y, p, q in zip(live, a, b, ends.tolist(), ends[1:].tolist()):
                mine = of[p:q]
                joined = ";".join([w.texts[c] for c in mine.tolist()])
                out[i].update(n_a=len(x), n_b=len(y), n_groups=int(w.n_groups[mine].sum()), n_links=int(sizes[mine].sum()),
                              sha=hashlib.sha256(joined.encode()).hexdigest(), n=q - p)
                if groups:
                    out[i]["groups"] = joined
            times = np.bincount(of, minlength=len(sizes))
        pairs, place = np.unique(code, return_inverse=True)
        n = np.bincount(place, weights=np.repeat(times, sizes), minlength=len(pairs)).astype(np.int64)
        # a place for each link of each distinct window, and the windows of the documents one after another
        return {"m": [rows["m"][0]], "docs": [out], "pairs": [pairs.tolist()], "n": [n.tolist()],
                "links": [pack(place.astype(np.int32))], "sizes": [pack(sizes.astype(np.int32))], "seq": [pack(of.astype(np.int32))]}

    blocks = pin(map_texts(x, block, f"m long, docs {made}, pairs array<long>, n array<long>, links binary, sizes binary, seq binary"), "aligned")
    pair = blocks.select("m", F.explode(F.arrays_zip("pairs", "n")).alias("p")).select("m", F.col("p.pairs").alias("pair"), F.col("p.n").alias("n"))
    # at most one row for each pair of ids
    count = pair.groupBy("pair").agg(F.sum("n").alias("count"))
    count = count.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))))
    count = pin(count, "pairs")
    answer = pair.select("m", "pair").join(count, "pair").groupBy("m").agg(F.collect_list(F.struct("pair", "count", "best")).alias("known"))

    def score(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups)}
        for found, known, links, sizes, seq in zip(*[rows[c] for c in ("docs", "known", "links", "sizes", "seq")]):
            place, size, order = unpack(links, np.int32), unpack(sizes, np.int32), unpack(seq, np.int32)
            ends = np.cumsum(size)
            v = sorted((r["pair"], r["count"], r["best"]) for r in known or [])
            totals = []
            for values in (np.array([r[2] for r in v], np.int64), np.array([r[1] for r in v], np.int64)):
                run = np.append(0, np.cumsum(values[place] if len(place) else np.zeros(0, np.int64)))
                of_window = run[ends] - run[ends - size]
                totals.append(np.append(0, np.cumsum(of_window[order] if len(order) else np.zeros(0, np.int64))))
            at = 0
            for d in found:
                for c, f in (("k", "k"), ("n_a", "n_a"), ("n_b", "n_b"), ("n_groups", "n_groups"), ("n_links", "n_links"), ("groups_sha256", "sha")):
                    out[c].append(d[f])
                if groups:
                    out["groups"].append(d["groups"])
                for c, t in zip(("n_best", "count_sum"), totals):
                    out[c].append(int(t[at + d["n"]] - t[at]))
                at += d["n"]
        return out

    schema = f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * groups
    y = blocks.drop("pairs", "n").join(answer, "m", "left").drop("m")
    return map_texts(y, score, schema, ("links", "seq")).withColumnRenamed("k", key)
