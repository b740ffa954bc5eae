"""Count tables of fixed width, gathered from all tasks: small enough to send to every task whatever the input."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELL = 1 << 14  # counts that travel in one row
CELL_SCHEMA = pa.schema([("cell", pa.int32()), ("counts", pa.binary())])


def slot(codes: np.ndarray, bits: int) -> np.ndarray:
    """Places of 64-bit hashes in a table of 2**bits counts."""
    return (codes.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def cells(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of a table that hold anything."""
    for k, start in enumerate(range(0, len(counts), CELL)):
        part = counts[start : start + CELL]
        if part.any():
            yield k, zlib.compress(part.astype(np.int64).tobytes(), 1)  # small numbers, mostly


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column("cell").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.int64)
            sums[k] = sums[k] + part if k in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], schema=CELL_SCHEMA)


def gathered(rows: DataFrame, size: int) -> np.ndarray:
    """Add up rows (cell, counts) of all tasks to a table of ``size`` counts, 8 bytes each; they reach the driver compressed."""
    parts = -(-size // CELL) or 1
    summed = rows.select("cell", "counts").repartition(min(parts, 64), "cell").mapInArrow(_add, "cell int, counts binary")
    out = np.zeros(size, np.int64)
    for r in summed.collect():
        part = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[r["cell"] * CELL : r["cell"] * CELL + len(part)] = part
    return out


def bits_of(places: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """The parts of a table of 2**bits flags that have any of the places set, packed."""
    places = np.unique(places)
    width = 8 * CELL
    for k in np.unique(places // width).tolist():
        flags = np.zeros(min(width, 1 << bits), bool)
        flags[places[np.searchsorted(places, k * width) : np.searchsorted(places, (k + 1) * width)] - k * width] = True
        yield k, np.packbits(flags).tobytes()


def _or(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column("cell").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(data, np.uint8)
            seen[k] = seen[k] | part if k in seen else part
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], schema=CELL_SCHEMA)


def gathered_bits(rows: DataFrame, bits: int) -> np.ndarray:
    """Join rows (cell, packed flags) of all tasks: 2**bits flags, 8 in a byte."""
    parts = max(1, (1 << bits) // (8 * CELL))
    joined = rows.select("cell", "counts").repartition(min(parts, 64), "cell").mapInArrow(_or, "cell int, counts binary")
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in joined.collect():
        out[r["cell"] * CELL : r["cell"] * CELL + len(r["counts"])] = np.frombuffer(r["counts"], np.uint8)
    return out


def marked(codes: DataFrame, bits: int) -> np.ndarray:
    """Which of 2**bits places the 64-bit codes of the only column fall on, as packed flags (test with ``hit``)."""

    def mark(batches):
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            cells = list(bits_of(slot(found, bits), bits))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cells], pa.int32()), pa.array([x for _, x in cells], pa.binary())], schema=CELL_SCHEMA)

    return gathered_bits(codes.mapInArrow(mark, "cell int, counts binary"), bits)


def hit(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = slot(codes, int(len(bitmap) * 8).bit_length() - 1)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
