"""How often the hashes of a whole table fall into each of a fixed number of buckets; the size doesn't grow with the table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import python_rows

#: Parts in which counts are added up, each in a task.
PARTS = 64
#: Hashes that are held before they are counted; scratch arrays take about 40 bytes each.
HELD = 1 << 20


def _partial(hashes: Callable, bits: int):
    mask = np.uint64((1 << bits) - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A byte a bucket: what is more common than that in one partition still stands out in the sum of all.
        total = np.zeros(1 << bits, dtype=np.uint8)

        def add(held: list[np.ndarray]) -> None:
            places, counts = np.unique(np.concatenate(held), return_counts=True)
            total[places] = np.minimum(total[places] + counts, 255)

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for found in hashes(batch):
                held.append((found & mask).astype(np.uint32))
                size += len(found)
                if size > HELD:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        parts = total.reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["part", "counts"])

    return rows


def _add(bits: int):
    def rows(pdf):
        import pandas as pd

        total = np.zeros((1 << bits) // PARTS, dtype=np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), dtype=np.uint8)
        # Eighths of powers of two, so that a byte tells frequencies up to 2**31 apart.
        scaled = np.minimum(np.ceil(8 * np.log2(1 + total)), 255).astype(np.uint8)
        return pd.DataFrame({"part": pdf["part"][:1], "counts": [zlib.compress(scaled.tobytes(), 1)]})

    return rows


def bucket_counts(df: DataFrame, hashes: Callable, bits: int) -> np.ndarray:
    """For each of 2**bits buckets 8 log2(1 + n), rounded up, n being how many hashes have it as their last bits.

    hashes: from a record batch of df to arrays of uint64. 2**bits bytes come to the driver.
    """
    parts = python_rows(df, _partial(hashes, bits), "part int, counts binary").groupBy("part").applyInPandas(_add(bits), "part int, counts binary").collect()
    out = np.zeros((PARTS, (1 << bits) // PARTS), dtype=np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint8)
    return out.reshape(-1)
