"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut where a rolling hash of the last bytes says so, hence passages that documents share fall
into equal chunks wherever they stand.  A chunk that occurs more than once is encoded once, by the
first text that holds it, and its ids are joined to all its places.  Ids of neighbouring parts do not
simply add up, so every join is repaired: the bytes around it are encoded again, over a widening
window, until both sides agree on the window's ends.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import int_lists, map_texts
from .common import pin
from .tokens import Encoder, encoder

#: Bytes that the rolling hash sees; a cut is made at 1 of 2**CUT_BITS places, chunks have LEAST to MOST bytes.
ROLL, CUT_BITS, LEAST, MOST = 16, 9, 128, 8192
BYTE_HASH = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
#: A split of the pre-tokenizer falls between a visible ASCII character and a blank or line feed, whatever stands around them.
SAFE = re.compile(rb"[\x21-\x7e](?=[ \n])")


def chunk_edges(b: bytes) -> list[int]:
    """0, the starts of the further chunks, and the length; never inside a UTF-8 character."""
    x = np.frombuffer(b, np.uint8)
    h = BYTE_HASH[x]
    for s in (1, 2, 4, 8):  # windows of 2, 4, 8, 16 bytes
        if len(h) > s:
            h = np.concatenate((h[:s], h[s:] + (h[:-s] << np.uint32(s))))
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    edges = [0]
    for p in [*at[(at >= ROLL) & (at < len(x))].tolist(), len(x)]:
        while p - edges[-1] > MOST:
            q = edges[-1] + MOST
            while x[q] & 0xC0 == 0x80:
                q -= 1
            edges.append(q)
        if p == len(x) or p - edges[-1] >= LEAST and x[p] & 0xC0 != 0x80:
            edges.append(p)
    return edges


def last_safe(b: bytes, p: int) -> int:
    """The last safe place at or before ``p``; 0 if there is none."""
    reach = 64
    while p > 0:
        low, found = max(0, p - reach), None
        for found in SAFE.finditer(b, low, min(len(b), p + 1)):
            pass
        if found:
            return found.end()
        if not low:
            break
        reach *= 4
    return 0


def first_safe(b: bytes, p: int, end: int) -> int:
    """The first safe place at or after ``p``; ``end`` if there is none before it."""
    found = SAFE.search(b, max(p - 1, 0), min(len(b), end + 1))
    return min(found.end(), end) if found else end


def encode_with(enc: Encoder, b: bytes, known: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Ids of the UTF-8 text ``b``, of which ``known`` gives those of some stretches: (start, end, ids), apart and in order."""
    parts, at = [], 0
    for s, e, ids in known:
        if at < s:
            parts.append((at, s, enc.encode(b[at:s].decode())))
        parts.append((s, e, ids))
        at = e
    if at < len(b) or not parts:
        parts.append((at, len(b), enc.encode(b[at:].decode())))
    done = [parts[0]]
    for s, e, ids in parts[1:]:
        # right: past the window, the ids of the part must have a boundary at its end
        ends, r = np.cumsum(enc.sizes[ids]), first_safe(b, s, e)
        while r < e and r > s and (ends.searchsorted(r - s) == len(ends) or ends[ends.searchsorted(r - s)] != r - s):
            r = first_safe(b, r + 1, e)
        rest = ids if r == s else ids[int(ends.searchsorted(r - s)) + 1:] if r < e else ids[:0]
        # left: the same before the window, taking back parts that it covers
        l = last_safe(b, s)
        while done and done[-1][1] > l:
            ps, pe, pids = done.pop()
            if l <= ps:
                continue
            ends = np.cumsum(enc.sizes[pids])
            i = int(ends.searchsorted(l - ps))
            if i < len(ends) and ends[i] == l - ps:
                done.append((ps, l, pids[:i + 1]))
                break
            done.append((ps, pe, pids))
            l = last_safe(b, l - 1)
        if l < r:
            done.append((l, r, enc.encode(b[l:r].decode())))
        if r < e:
            done.append((r, e, rest))
    return np.concatenate([ids for _, _, ids in done])


def shared_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``k, t1, t2, text`` (t1, t2: hash of the text): distinct texts, places of chunks, and who encodes shared ones.

    Texts: ``tid, t1, t2, k``.  Places: ``tid, at, c1, c2``, one for each distinct text and chunk; ``at`` is the
    chunk's start * 2**32 + size.  Owners: ``t1, t2, k, todo`` with the chunks that occur more than once and are to
    be encoded from that row's text.
    """
    def work(rows: dict[str, list]) -> dict[str, list]:
        out = []
        for t in rows.pop("text"):
            b, chunks = t.encode(), []
            edges = chunk_edges(b)
            for s, e in zip(edges, edges[1:]):
                h = xxhash.xxh3_128_intdigest(b[s:e])
                chunks.append((s << 32 | e - s, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
            out.append(chunks)
        return rows | {c: [[x[i] for x in chunks] for chunks in out] for i, c in enumerate(("at", "c1", "c2"))}

    kind = docs.schema["k"].dataType.simpleString()
    cut = map_texts(docs, work, f"k {kind}, t1 long, t2 long, at array<long>, c1 array<long>, c2 array<long>")
    # exact copies have the same chunks: one row for all of them, numbered as it is written
    texts = pin(cut.groupBy("t1", "t2").agg(F.min("k").alias("k"), *[F.first(c).alias(c) for c in ("at", "c1", "c2")])
                .withColumn("tid", F.monotonically_increasing_id()), "chunks")
    place = texts.select("tid", F.explode(F.arrays_zip("at", "c1", "c2")).alias("c")).select("tid", "c.*")
    first = place.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "at")).alias("p")).where("n > 1")
    todo = first.select("p.tid", "p.at", "c1", "c2").groupBy("tid").agg(F.collect_list(F.struct("at", "c1", "c2")).alias("todo"))
    texts = texts.select("tid", "t1", "t2", "k")
    return texts, place, texts.join(todo, "tid").select("t1", "t2", "k", "todo")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row's whole text (null: empty), as ``tokenizers`` gives them.

    With ``decoded`` also the text that the ids decode to, made in the same pass.  Rows with equal or null keys stay
    apart; other columns are ignored.  Tokenizer files that are no plain byte-level BPE have no safe places to repair
    joins at: their texts are encoded as they stand.
    """
    kind = docs.schema[key].dataType.simpleString()
    x = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"k {kind}, ids array<int>" + ", decoded string" * decoded

    def result(rows: dict[str, list], ids: list[np.ndarray]) -> dict[str, list]:
        back = {"decoded": [encoder(path).decode(i) for i in ids]} if decoded else {}
        return {"k": rows["k"], "ids": int_lists(ids), **back}

    if not encoder(path).exact:
        def plain(rows: dict[str, list]) -> dict[str, list]:
            return result(rows, [encoder(path).encode(t) for t in rows["text"]])
        return map_texts(x, plain, schema).withColumnRenamed("k", key)

    packed = "<u2" if len(encoder(path).pieces) <= 1 << 16 else "<u4"
    x = x.withColumns({f"t{i}": F.xxhash64(F.lit(i), F.col("text")) for i in (1, 2)})
    texts, place, owners = shared_chunks(x)

    def squeeze(rows: dict[str, list]) -> dict[str, list]:
        z = zstandard.ZstdCompressor(level=3)
        return rows | {"z": [z.compress(t.encode()) for t in rows.pop("text")]}

    # The texts go compressed through the one shuffle that both joins below share; the filter (hashes are never
    # null) is what an inner join adds by itself, and makes both sides alike.
    z = map_texts(x, squeeze, f"k {kind}, t1 long, t2 long, z binary").where("t1 is not null and t2 is not null")

    def encode_chunks(rows: dict[str, list]) -> dict[str, list]:
        out, enc = {"c1": [], "c2": [], "ids": []}, encoder(path)
        for t, todo, k, owner in zip(rows["z"], rows["todo"], rows["k"], rows["o_k"]):
            if k != owner:
                continue
            b = zstandard.ZstdDecompressor().decompress(t)
            for c in todo:
                start, size = c["at"] >> 32, c["at"] & 0xFFFFFFFF
                out["c1"].append(c["c1"])
                out["c2"].append(c["c2"])
                out["ids"].append(enc.encode(b[start:start + size].decode()).astype(packed).tobytes())
        return out

    o = owners.select(*[F.col(c).alias(f"o_{c}") for c in ("t1", "t2", "k")], "todo")
    same = (F.col("t1") == F.col("o_t1")) & (F.col("t2") == F.col("o_t2"))
    # joined by the text's hash alone, as below, so that both joins share one shuffle of the texts
    held = z.join(o, same).select("k", "o_k", "z", "todo")
    once = map_texts(held, encode_chunks, "c1 long, c2 long, ids binary", ("z",)).dropDuplicates(["c1", "c2"])
    parts = place.join(once, ["c1", "c2"]).groupBy("tid").agg(F.collect_list(F.struct("at", "ids")).alias("known"))
    parts = texts.join(parts, "tid").select(F.col("t1").alias("o_t1"), F.col("t2").alias("o_t2"), "known")
    y = z.join(parts, same, "left").select("k", "z", "known")

    def assemble(rows: dict[str, list]) -> dict[str, list]:
        enc, ids = encoder(path), []
        for t, known in zip(rows["z"], rows["known"]):
            b = zstandard.ZstdDecompressor().decompress(t)
            stretches = [(a >> 32, (a >> 32) + (a & 0xFFFFFFFF), np.frombuffer(i, packed)) for a, i in sorted((p["at"], p["ids"]) for p in known or [])]
            ids.append(encode_with(enc, b, stretches) if stretches else enc.encode(b.decode()))
        return result(rows, ids)

    return map_texts(y, assemble, schema, ("z",)).withColumnRenamed("k", key)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``out`` instead of ``ids`` (null ids: null)."""
    keep = [c for c in rows.columns if c not in (ids, out)]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(cols: dict) -> dict:
        lists, enc = cols.pop("_ids"), encoder(path)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        alive = lists.is_valid().to_pylist()
        cols["_text"] = [enc.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], alive)]
        return {f"c{i}": cols[f"c{i}"] for i in range(len(keep))} | {"_text": cols["_text"]}

    x = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(ids).alias("_ids"))
    schema = ", ".join([*[f"c{i} {types[c]}" for i, c in enumerate(keep)], "_text string"])
    y = map_texts(x, work, schema, ("_ids",), ("_ids",))
    return y.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias(out))
