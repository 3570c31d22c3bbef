"""Packing: pieces against the tokenizers library, layouts checked piece by piece, counts against best-fit decreasing."""

import bisect
import signal
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from beaconflow.llm import packing
from beaconflow.llm.queries import QUERIES
from beaconflow.llm.tokens import encoder

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, n)
        left = room.pop(i) - n if i < len(room) else capacity - n
        bisect.insort(room, left)
    return len(room)


def want_pieces(docs, capacity=1024):
    slow, out = Tokenizer.from_file(PATH), []
    for k, t in docs:
        ids = np.array(slow.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        a = i = 0
        b = first
        while a < len(ids):
            out.append((k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            a, b, i = b, b + capacity, i + 1
    return out


def check(rows, docs, capacity=1024):
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want_pieces(docs, capacity), key=key)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    assert check(rows, docs) <= best_fit([r.length for r in rows], 1024)


def test_odd_documents(spark):
    docs = [(1, None), (1, ""), (None, "a"), (None, "a"), (2, "word " * 5000), (3, "x y z" * 700), (4, "<|endoftext|> é\n\n  z")] + [(9, "same text")] * 50
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, piece string")
    check(packing.pack(df.repartition(4), PATH).collect(), docs)
    check(packing.pack(df, PATH, capacity=16).collect(), docs, 16)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_configurations_cover_exactly():
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 40, 257), np.bincount([200] * 100 + [57] * 99, minlength=257), np.bincount([256] * 7, minlength=257)):
        counts[0] = 0
        plan, seen = packing.configurations(counts, 256), np.zeros(257, int)
        for config, n in plan:
            assert sum(l * k for l, k in config) <= 256
            for l, k in config:
                seen[l] += k * n
        assert (seen == counts).all()
        lengths = np.repeat(np.arange(257), counts)
        assert sum(n for _, n in plan) <= best_fit(lengths.tolist(), 256)


def place_best_fit(need: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing on counts: uses of configurations, as one piece after the other would give.

    A sequence that takes a piece stays the fullest that fits until it has no room for another, so sequences
    of one room and content fill up together; each length parts at most one such group.
    """
    groups: Counter = Counter()  # (room, pieces): sequences
    for l in range(capacity, 0, -1):
        n = int(need[l])
        for room, held in sorted(g for g in groups if g[0] >= l) if n else ():
            k = room // l
            full = min(groups[room, held], n // k)
            n -= full * k
            rest = n if full < groups[room, held] else 0
            for uses, copies in ((full, k), (1, rest)):
                if uses and copies:
                    groups[room, held] -= uses
                    groups[room - copies * l, (*held, (l, copies))] += uses
            n -= rest
            if not groups[room, held]:
                del groups[room, held]
            if not n:
                break
        k = capacity // l
        for uses, copies in ((n // k, k), (1, n % k)):
            if uses and copies:
                groups[capacity - copies * l, ((l, copies),)] += uses
    out: Counter = Counter()
    for (_, held), uses in groups.items():
        out[tuple(sorted(held))] += uses
    return out


def by_pieces(need, capacity):
    seqs = []
    for l in np.repeat(np.arange(len(need)), need)[::-1].tolist():
        fits = [(capacity - sum(s), i) for i, s in enumerate(seqs) if capacity - sum(s) >= l]
        if fits:
            seqs[min(fits)[1]].append(l)
        else:
            seqs.append([l])
    return seqs


def test_best_fit_by_counts_is_best_fit_by_pieces():
    rng = np.random.default_rng(6)
    for _ in range(60):
        need = rng.integers(0, 9, 65) * (rng.random(65) < 0.4)
        need[0] = 0
        got = place_best_fit(need, 64)
        assert sum(got.values()) == len(by_pieces(need, 64))
        assert all(0 < sum(l * k for l, k in c) <= 64 and n > 0 for c, n in got.items())
        seen = Counter()
        for c, n in got.items():
            for l, k in c:
                seen[l] += k * n
        assert seen == Counter({l: int(n) for l, n in enumerate(need) if n})


def test_a_million_pieces_of_a_length():
    signal.alarm(100)  # piece by piece it would take days
    try:
        for lengths, most in (({600: 10**6}, 10**6), ({600: 10**6, 300: 10**6}, 10**6), ({600: 10**6, 550: 3 * 10**5, 410: 7 * 10**5, 333: 99}, 13 * 10**5)):
            counts = np.zeros(1025, np.int64)
            for l, n in lengths.items():
                counts[l] = n
            plan, seen = packing.configurations(counts, 1024), Counter()
            for config, n in plan:
                assert sum(l * k for l, k in config) <= 1024
                for l, k in config:
                    seen[l] += k * n
            assert seen == Counter(lengths) and sum(n for _, n in plan) <= most
    finally:
        signal.alarm(0)


def histogram_of(sf, capacity=1024):
    import pyarrow.parquet as pq
    enc, counts = encoder(PATH), np.zeros(capacity + 1, np.int64)
    for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(enc.encode(t or "")) + 1
        counts[capacity] += n // capacity
        if n % capacity:
            counts[n % capacity] += 1
    return counts


def test_the_program_is_solved_and_not_best_fit():
    """Within 0.1 % of the lower bound, which no packing can pass, and below what best-fit decreasing gives."""
    counts = histogram_of("sf0.1")
    plan = packing.configurations(counts, 1024)
    used, bound = packing.solve(counts, 1024, 0.005)
    assert bound <= sum(n for _, n in plan) <= sum(used.values()) <= 1.001 * bound
    assert sum(n for _, n in plan) < sum(place_best_fit(counts, 1024).values())
    assert bound >= np.ceil((np.arange(1025) * counts).sum() / 1024)


def test_the_bound_holds_against_all_packings():
    """Small cases by exhaustive search: bound <= optimum <= what the solver uses."""
    rng = np.random.default_rng(8)

    def least(items, capacity):
        best = [len(items)]

        def put(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for r in sorted({x for x in rooms if x >= items[i]}):
                k = rooms.index(r)
                put(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1:])
            put(i + 1, rooms + [capacity - items[i]])
        put(0, [])
        return best[0]

    for _ in range(30):
        items = sorted(rng.integers(3, 13, 9).tolist(), reverse=True)
        used, bound = packing.solve(np.bincount(items, minlength=21), 20, 0.01)
        assert bound <= least(items, 20) <= sum(used.values())
