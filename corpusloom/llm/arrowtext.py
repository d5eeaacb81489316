"""Arrow and numpy helpers shared by the text operators: bounded slices, byte views, rolling hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step works on; numpy needs some 60 bytes for each.
SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes in ``column`` (a longer row comes alone)."""
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def over_slices(
    f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, most: int = SLICE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that applies ``f`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                if (out := f(part)) is not None and out.num_rows:
                    yield out

    return run


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and the n+1 offsets of the rows in them; a null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, _ODD), np.full(n, inverse)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash of ``values``; with it any span hashes in constant time (see span_hash)."""
    n = len(values) + 1
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    total = np.zeros(n, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=total[1:])
    return total, down


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal content gives equal hashes wherever it stands."""
    total, down = prefix
    return mix((total[end] - total[start]) * down[start])


def int_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
