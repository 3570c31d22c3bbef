"""Collocations: phrases of two to four words whose words occur together more often than apart.

Top-order marginalisation: every word begins one window of up to ``most`` words, cut and padded at the end of its
piece.  Only these longest windows are counted; a ROLLUP over their word columns sums the counts of all shorter
prefixes, and every occurrence of a phrase is the prefix of exactly one window.

A window may be cut earlier: a phrase of at least ``least`` occurrences holds no word, pair or longer part with fewer.
Two passes add up parts by hash in counters (parts may share one, so a counter never falls short): words and pairs, then
longer parts whose pairs may be frequent.  Windows end before a part whose counter stays below ``least``.  This loses no
candidate, whatever the number of counters; more of them only leave fewer windows to count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_within
from .batches import map_texts, mix64
from .common import pin
from .sums import pack, unpack

#: Lower case of A-Z, blanks, and the bytes that end a piece.
LOWER = {**{i: i + 32 for i in range(65, 91)}, 9: 32}
BREAKS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(10 if b in BREAKS else LOWER.get(b, b) for b in range(256))
#: Slots of one written piece of the counters; bytes of text for one slot; fewest and most slots (powers of two).
CHUNK, BYTES_PER_SLOT, FEWEST, MOST = 16, 48, 18, 28


def word_ids(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts as numbers, -1 at every end of a piece, and the words in order of their numbers.

    A-Z are lowered; ``.,;:!?`` and the code points 10 to 13 end a piece, as does a text; blanks and tabs end a word.
    """
    found: list[bytes] = []
    for t in texts:
        found += t.encode().translate(TABLE).replace(b"\n", b" \n ").split(b" ")
        found.append(b"\n")
    number: dict[bytes, int] = {b"\n": -1}
    ids = np.fromiter((number.setdefault(w, len(number) - 1) for w in found if w), np.int64)
    return ids, list(number)[1:]


def part_slots(ids: np.ndarray, words: list[bytes], lang: str, bits: int, most: int) -> list[np.ndarray]:
    """For parts of 1 to ``most`` words: the slot of the part that begins at each place, -1 where its piece is too short."""
    if not len(ids):
        return [np.zeros(0, np.int64)] * most
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    word = mix64(np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words] + [0], np.uint64))[ids]
    out, h, whole = [], word, ids >= 0
    for m in range(1, most + 1):
        if m > 1:
            whole = whole & (np.append(ids[m - 1:], np.full(min(m - 1, len(ids)), -1))[:len(ids)] >= 0)
            h = mix64(h + np.append(word[m - 1:], np.zeros(min(m - 1, len(ids)), np.uint64))[:len(ids)])
        out.append(np.where(whole, (h >> np.uint64(64 - bits)).astype(np.int64), -1))
    return out


def after(x: np.ndarray, i: int) -> np.ndarray:
    """What stands ``i`` places later (nothing beyond the end)."""
    return np.append(x[i:], np.zeros(min(i, len(x)), bool))


def may_begin(slots: list[np.ndarray], often: dict[int, np.ndarray]) -> list[np.ndarray]:
    """For parts of 1, 2, ... words: whether one that begins at a place may be frequent, by the counters known so far."""
    out: list[np.ndarray] = []
    for m, slot in enumerate(slots, 1):
        go = slot >= 0
        if out:
            go &= out[-1] & after(out[-1], 1)
        if m in often:
            go &= (often[m][slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
        out.append(go)
    return out


def by_lang(rows: dict[str, list]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, text in zip(rows["lang"], rows["text"]):
        if text:
            out.setdefault(lang, []).append(text)
    return out


def pack_counts(places: np.ndarray, n: np.ndarray) -> bytes:
    """Increasing places below 2**16 and their counts below 256; gaps, low and high bytes apart, pack better than places."""
    gaps = np.diff(places, prepend=0)
    return pack(np.concatenate([gaps & 255, gaps >> 8, n]).astype(np.uint8))


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, n = unpack(blob, np.uint8).reshape(3, -1).astype(np.int64)
    return np.cumsum(low + (high << 8)), n


def frequent_slots(x: DataFrame, sizes: list[int], known: dict[int, np.ndarray], bits: int, least: int) -> dict[int, np.ndarray]:
    """For parts of each of ``sizes``: a bit for each slot, whether its parts occur ``least`` times or more.

    Parts that cannot be frequent by the ``known`` bits are left out.  Every slice of texts sends its counters, no higher
    than ``least``, in pieces of 2**CHUNK slots; sums are cut at ``least`` too, so that a byte holds each.  What reaches the
    driver is bounded by 2**MOST bits (32 MB) for each size.
    """
    if not 0 < least < 256:
        raise ValueError("a counter holds 1 to 255")
    shared = x.sparkSession.sparkContext.broadcast(known)

    def count(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"size": [], "chunk": [], "blob": []}
        found: dict[int, list[np.ndarray]] = {m: [np.zeros(0, np.int64)] for m in sizes}
        for lang, texts in by_lang(rows).items():
            slots = part_slots(*word_ids(texts), lang, bits, max(sizes))
            go = may_begin(slots, shared.value)
            for m in sizes:
                found[m].append(slots[m - 1][go[m - 1]])
        for m in sizes:
            slot, n = np.unique(np.concatenate(found[m]), return_counts=True)
            ends = np.flatnonzero(np.diff(slot >> CHUNK, append=-1)) + 1
            for a, b in zip([0, *ends[:-1]], ends):
                out["size"].append(m)
                out["chunk"].append(int(slot[a] >> CHUNK))
                out["blob"].append(pack_counts(slot[a:b] & (1 << CHUNK) - 1, np.minimum(n[a:b], least)))
        return out

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for m, c, blob in zip(*[batch.column(i).to_pylist() for i in ("size", "chunk", "blob")]):
                places, n = unpack_counts(blob)
                have = total.setdefault((m, c), np.zeros(1 << CHUNK, np.uint8))
                have[places] = np.minimum(have[places].astype(np.int64) + n, least)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)] + [
                pa.array([pack(np.packbits(v >= least)) for v in total.values()], pa.binary())], ["size", "chunk", "blob"])

    schema = "size int, chunk int, blob binary"
    summed = map_texts(x, count, schema).repartition("size", "chunk").mapInArrow(add, schema)
    out, step = {m: np.zeros((1 << bits) // 8, np.uint8) for m in sizes}, (1 << CHUNK) // 8
    for r in summed.toLocalIterator():
        out[r["size"]][r.chunk * step:(r.chunk + 1) * step] = unpack(bytes(r.blob), np.uint8)
    return out


def windows(x: DataFrame, often: dict[int, np.ndarray], bits: int, most: int) -> DataFrame:
    """``lang, window, n``: the windows that words begin, blanks between their words, with how often.

    A window ends with its piece, and before a part that is too rare (all of it, where its first word is).  Equal windows
    of a slice are one row.  One string for a window is about half as long a row as a column for each word.
    """
    shared = x.sparkSession.sparkContext.broadcast(often)

    def count(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "window": [], "n": []}
        for lang, texts in by_lang(rows).items():
            ids, words = word_ids(texts)
            go = may_begin(part_slots(ids, words, lang, bits, most), shared.value)
            # the lead columns: the words that follow by one, two, ... places, as far as the window goes
            here = np.flatnonzero(ids >= 0)
            leads, none, key = [], len(words), np.zeros(len(here), np.int64)
            for i in range(most):
                leads.append(np.where(go[i][here], ids[np.minimum(here + i, len(ids) - 1)], none))
                # equal prefixes have equal numbers, so a key stays below places * words
                key = (np.unique(key, return_inverse=True)[1] if i else key) * (none + 1) + leads[i]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            if not len(first):
                continue
            names = pa.array([w.decode() for w in words] + [None], pa.string())
            held = [names.take(pa.array(lead[first])) for lead in leads]
            # words hold no blanks, so a window can be split again; one without words is ''
            out["window"].append(pc.binary_join_element_wise(pc.fill_null(held[0], ""), *held[1:], " ", null_handling="skip"))
            out["n"].append(pa.array(n.astype(np.int64)))
            out["lang"].append(pa.array([lang]).take(pa.array(np.zeros(len(first), np.int64))))
        return {c: pa.concat_arrays(v) if v else [] for c, v in out.items()}

    return map_texts(x, count, "lang string, window string, n long")


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 4, least: int = 30) -> DataFrame:
    """``lang, size, phrase, f``: all phrases of 1 to ``most`` words that occur ``least`` times, and (size 0) all words.

    Windows are counted once, by all their columns; ROLLUP sums the shorter prefixes.  Languages stay apart; a null
    language is ``und``, a null text empty.
    """
    x = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    size = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(FEWEST, min(MOST, (size // BYTES_PER_SLOT).bit_length()))
    columns = [f"w{i + 1}" for i in range(most)]
    often = frequent_slots(x, list(range(1, min(2, most) + 1)), {}, bits, least)
    if most > 2:
        often |= frequent_slots(x, list(range(3, most + 1)), often, bits, least)
    counted = windows(x, often, bits, most).groupBy("lang", "window").agg(F.sum("n").alias("n"))
    word = F.split("window", " ")  # '' beyond the end of a window
    counted = counted.select("lang", *[F.coalesce(F.get(word, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)], "n")
    sums = counted.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("_g"))
    # grouping_id has a bit for every column that was summed away; a padded prefix belongs to a shorter phrase
    depth = sum(F.when(F.col("_g").bitwiseAND(F.lit(1 << i)) == 0, 1).otherwise(0) for i in range(most))
    sums = sums.where(F.col("_g") < F.lit(1 << most)).withColumn("size", depth.cast("int"))
    last = F.when(F.col("size") > 0, F.element_at(F.array(*columns), F.greatest("size", F.lit(1))))
    phrase = F.array_join(F.slice(F.array(*columns), F.lit(1), F.col("size")), " ")
    return sums.where((F.col("size") == 0) | (last != "") & (F.col("f") >= least)).select("lang", "size", phrase.alias("phrase"), "f")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 4, least: int = 30, top: int = 2000,
                 scale: int = 2_000_000, covered: int = 80) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to ``most`` words with a >= ``least`` occurrences is scored at its weakest cut: the least
    floor(scale * a / (l + r)) over its cuts into a first part with l and a rest with r occurrences (ties: the earliest
    cut).  A phrase goes when a longer one that holds it has ``covered`` percent of its occurrences or more.  Order:
    score, occurrences (descending), phrase (bytes).  Rows are pieces of text only: ids, repeated rows and other columns
    do not matter; no text gives no row.
    """
    f = pin(frequencies(docs, text, lang, most, least), "phrases")
    known = f.where("size > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    cand = f.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size")

    cut = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({
        "first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
        "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")})
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast(a as decimal(19,0)) * {scale}) div (cast(l as decimal(19,0)) + r)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.score")

    # what longer candidates hold: all their stretches of at least two words
    starts = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))).alias("phrase")
    longer = cand.where("size > 2").select("lang", F.col("a").alias("longer"), starts).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.coalesce(F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * covered, F.lit(False))
    left = scored.join(longer, ["lang", "phrase"], "left").where(~held)

    # ranked over range partitions: no language is gathered in one task
    ranked = rank_within(pin(left, "scored"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")])
    best = ranked.where(F.col("_rank") < top).withColumn("rank", F.col("_rank") + 1)
    total = f.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
