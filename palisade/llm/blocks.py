"""Large fixed-size arrays, summed or joined over all tasks in pieces.

A task gives its array as rows (part, compressed piece). Pieces of one part are merged as a stream,
one piece at a time, so nothing grows with the number of tasks but the time of the merge; the
result has the array's fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1024
#: Least and most bits of a filter; in between, eight for each key.
FILTER_BITS = 1 << 20, 1 << 27
SCHEMA = "part int, piece binary"


def pieces(array: np.ndarray, dtype: type | None = None) -> pa.RecordBatch:
    """Rows of one task's array, as ``dtype``; pieces of zeros only are left out."""
    cut = array.reshape(PARTS, -1)
    used = np.flatnonzero(cut.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used.astype(np.int32)),
            pa.array([zlib.compress(cut[i].astype(dtype or array.dtype).tobytes(), 1) for i in used], pa.binary()),
        ],
        ["part", "piece"],
    )


def merged(frame: DataFrame, size: int, dtype: str, join: str) -> np.ndarray:
    """The array of ``size`` items of which ``frame`` has pieces; ``join``: ``add`` or ``bitwise_or``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(zlib.decompress(piece), dtype=dtype)
                sums[part] = getattr(np, join)(sums[part], values) if part in sums else values
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary()),
            ],
            ["part", "piece"],
        )

    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frame.repartition(min(n, PARTS), F.col("part")).mapInArrow(merge, SCHEMA).collect()
    whole = np.zeros((PARTS, size // PARTS), dtype=dtype)
    for row in rows:
        whole[row.part] = np.frombuffer(zlib.decompress(bytes(row.piece)), dtype=dtype)
    return whole.reshape(-1)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the 64-bit hashes in the one column of ``keys``."""
    least, most = FILTER_BITS
    n_bits = min(max(1 << (8 * keys.count()).bit_length(), least), most)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_bits // 8, dtype=np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & (n_bits - 1)
            np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pieces(found)

    return merged(keys.mapInArrow(bits, SCHEMA), n_bits // 8, "u1", "bitwise_or")


def passing(bits: np.ndarray, keys):
    """Whether ``keys`` (an array, or one) are in a ``bit_filter``, which may let others through."""
    at = keys & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) if isinstance(keys, np.ndarray) else bits[at >> 3] >> (at & 7) & 1
