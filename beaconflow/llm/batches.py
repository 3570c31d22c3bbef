"""Arrow batches of texts in bounded slices, and words as numpy hashes (inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import ship_package

#: A slice holds at most so many bytes of text (one longer text is a slice of its own) and rows.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 2000
#: The six bytes that separate words.
SPACES = b" \t\n\x0b\x0c\r"
#: Whether a byte stands between words, bytes with A-Z lowered, the base of word hashes (odd) and its inverse modulo 2**64.
SPACE = np.isin(np.arange(256), list(SPACES))
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1)
AS_IS = np.arange(256).astype(np.uint64) + np.uint64(1)
BASE = 0xD6E8FEB86659FD93
POWERS = np.cumprod(np.full(1 << 19, BASE, np.uint64))
INVERSE = np.cumprod(np.full(1 << 19, pow(BASE, -1, 1 << 64), np.uint64))


def slices(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named text, binary or integer list columns hold about ``SLICE_BYTES`` in each slice."""
    size = np.zeros(batch.num_rows, np.int64)
    for t in texts:
        c = batch.column(t)
        held = pc.multiply(pc.list_value_length(c), 4) if pa.types.is_list(c.type) else pc.binary_length(c)
        size += np.asarray(pc.fill_null(held, 0).to_numpy(zero_copy_only=False), np.int64)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str,
              texts: tuple[str, ...] = ("text",), raw: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``work`` (columns as lists -> columns as lists) to slices of ``df``; rows may come and go.

    ``raw`` columns are handed over as Arrow arrays; results may be Arrow arrays too.
    """
    ship_package(df.sparkSession)
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, list(texts)):
                out = work({c: part.column(c) if c in raw else part.column(c).to_pylist() for c in part.schema.names})
                cols = [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in made]
                yield pa.RecordBatch.from_arrays(cols, schema=made)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers stay for later tasks, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def add_columns(docs: DataFrame, keep: list[str], text: str, new: str, work: Callable[[list], dict[str, list]]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the columns that ``work`` makes of the texts (in place of any of that name).

    ``new`` is their schema.  Kept columns go along as they are; the text is sent once and comes back only if ``keep`` names it.
    """
    made = [f.name for f in StructType.fromDDL(new)]
    keep = [c for c in dict.fromkeys(keep) if c not in made]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    sent = {c: f"_c{i}" for i, c in enumerate(keep) if c != text or types[c] != "string"}
    x = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in sent.items()], F.col(f"`{text}`").cast("string").alias("_t"))
    back = {c: sent.get(c, "_t") for c in keep}

    def run(cols: dict) -> dict:
        return cols | work(cols["_t"].to_pylist())

    schema = ", ".join([*[f"{a} {types[c]}" for c, a in back.items()], new])
    out = map_texts(x, run, schema, ("_t",), (*sent.values(), "_t"))
    return out.select(*[F.col(a).alias(c) for c, a in back.items()], *made)


def int_lists(parts: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list array of the given integer arrays."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each window of ``n`` word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j])
    return out


def batches_of(texts: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered unless told otherwise), and the number of words of each text.

    One running sum of bytes times powers of a base over the joined texts; a word is the difference
    at its ends, moved back to power one.  Works on about a quarter of a megabyte at a time, longer texts cut between words.
    """
    parts, of = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > 1 << 18:
            cut = max(t.rfind(c, at + 1, at + (1 << 18)) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:  # one word over all of it
                cut = min((e for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := t.find(c, at + 1)) > 0), default=len(t))
            parts.append(t[at:cut])
            of.append(i)
            at = cut
        parts.append(t[at:])
        of.append(i)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, j in batches_of(parts, 1 << 18):
        joined = b"\n" + b"\n".join(parts[i:j]) + b"\n"
        x = np.frombuffer(joined, np.uint8)
        power, inverse = POWERS, INVERSE
        if len(x) > len(power):  # one very long word
            power, inverse = (np.cumprod(np.full(len(x), b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
        space = SPACE[x]
        total = np.cumsum((LOWER if lower else AS_IS)[x] * power[:len(x)])
        edge = np.flatnonzero(space[1:] != space[:-1])  # the last byte before each change
        s, e = edge[0::2], edge[1::2]
        h = (total[e] - total[s]) * inverse[s]
        hashes.append(mix64(h ^ ((e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        starts = np.cumsum([0, *[len(t) + 1 for t in parts[i:j - 1]]])
        np.add.at(counts, np.array(of[i:j]), np.diff(np.append(np.searchsorted(s, starts), len(s))))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts
