"""Moving fixed-width records between tasks as packed bytes.

A task sorts its records by bucket (the top bits of a hash), so that a shuffle
moves a few binary rows instead of millions of small ones; the task that gets a
bucket sees all its records as one numpy array. A bucket holds about
1 / buckets of all records. Callers reduce what one task sends for a key to a
fixed number of records, so that a hot key costs a bucket as many records as
there are tasks, not as many as there are rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKED = "bucket int, data binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def bits_for(width: int) -> int:
    """Bits of bucket number for two buckets or more in each of ``width`` shuffle partitions."""
    return max(4, min(24, (2 * width - 1).bit_length()))


def packed(records: np.ndarray, hashes: np.ndarray, bits: int, first: int = 0) -> pa.RecordBatch:
    """Records as one binary row per bucket; buckets are numbered from ``first``."""
    number = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    found, start = np.unique(number[order], return_index=True)
    held, width = np.ascontiguousarray(records[order]), records.dtype.itemsize  # the only copy: rows are cut from its bytes
    at = np.concatenate([start, [len(order)]]) * width
    if at[-1] >= 1 << 31:
        raise ValueError("records of 2 GB at once; send them in parts")
    rows = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(held.view(np.uint8))])
    return pa.RecordBatch.from_arrays([pa.array((found + first).astype(np.int32)), rows], schema=PACKED_ARROW)


def by_bucket(sent: DataFrame, run: Callable[[int, bytes], Iterator[pa.RecordBatch]], schema: str, finish: Callable[[], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """``run(bucket, all its bytes)`` for each bucket, one bucket in memory at a time; ``finish`` ends the task."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != now and parts:
                    yield from run(now, b"".join(parts))
                    parts = []
                now = b
                parts.append(data.as_py())
        if parts:
            yield from run(now, b"".join(parts))
        if finish is not None:
            yield from finish()

    width = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(grouped, schema)


class Membership:
    """A Bloom filter in segments: segment i answers for the hashes of bucket i. Bounded by its parts' sizes."""

    PROBES = 3

    def __init__(self, bits: int, parts: dict[int, bytes]) -> None:
        self.shift = np.uint64(64 - bits)
        size = np.zeros(1 << bits, np.int64)
        for i, p in parts.items():
            size[i] = len(p)
        self.at, self.size = (np.cumsum(size) - size) * 8, size * 8
        self.raw = np.frombuffer(b"".join(parts[i] for i in sorted(parts)) or b"\0", np.uint8)

    @classmethod
    def part(cls, hashes: np.ndarray, nbytes: int) -> bytes:
        """The segment that holds ``hashes``."""
        flags = np.zeros(nbytes * 8, np.uint8)
        for place in cls.places(hashes, np.int64(nbytes * 8)):
            flags[place] = 1
        return np.packbits(flags, bitorder="little").tobytes()

    @classmethod
    def places(cls, hashes: np.ndarray, size) -> Iterator[np.ndarray]:
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)
        step = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) | 1
        for i in range(cls.PROBES):
            yield (low + i * step) % size

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        seg = (hashes >> self.shift).astype(np.int64)
        size = self.size[seg]
        out = size > 0
        for place in self.places(hashes, np.maximum(size, 1)):
            bit = self.at[seg] + place
            out &= (self.raw[np.minimum(bit >> 3, len(self.raw) - 1)] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out
