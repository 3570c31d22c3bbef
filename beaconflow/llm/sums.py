"""Sums of large count tables over the whole corpus, without gathering them in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: their differences, equal bytes together."""
    d = np.diff(a.astype(np.uint64, copy=False), prepend=np.uint64(0))
    return pack(d.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel())


def summed(rows: DataFrame) -> DataFrame:
    """``tab, chunk, blob`` rows, one for each table chunk: the sums of all blobs (packed int64 arrays) of that chunk.

    Chunks are dealt out by their key; a task adds up what streams by, so it holds no more than the
    chunks' sums, however many rows a chunk has.
    """
    made = pa.schema([("tab", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for t, c, b in zip(*[batch.column(n).to_pylist() for n in ("tab", "chunk", "blob")]):
                x = unpack(b, np.int64)
                if (t, c) in total:
                    total[t, c] += x
                else:
                    total[t, c] = x.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
                                              pa.array([pack(v) for v in total.values()], pa.binary())], schema=made)

    return rows.select("tab", "chunk", "blob").repartition("tab", "chunk").mapInArrow(run, "tab int, chunk int, blob binary")
