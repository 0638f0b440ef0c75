"""Texts of an Arrow batch as bytes, and hashes of any stretch of them from prefix sums (numpy, inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at a time; arrays of 8 bytes per text byte exist for one such block only.
BLOCK_BYTES = 1 << 21
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2^64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(BASE))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, kept up to the longest block seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, step in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, step, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


def prefix_hashes(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix polynomial hashes modulo 2^64, one more than bytes."""
    up, _ = powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=out[1:])
    return out


def stretch_hashes(prefix: np.ndarray, powers: Powers, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop], equal for equal bytes wherever they stand."""
    _, down = powers.upto(len(prefix))
    return (prefix[stop] - prefix[start]) * down[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return flat, offsets - offsets[0]


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; after the last one a worker gives the memory its libraries keep free back to the system, so that it does
    not stand beside the joins and sorts that follow."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU systems
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str, block_bytes: int = BLOCK_BYTES) -> Iterator:
    """(batch of whole rows, bytes, offsets) of about ``block_bytes`` each; a longer text is a block of its own."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end
