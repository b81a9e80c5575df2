"""Filters of fixed size: which values of a hash a table may hold. A join always decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bits_of(rows: DataFrame, hash_: str, size: int) -> np.ndarray:
    """A bit per possible value of the low bits of a hash, set where ``rows`` have one; ``size`` bits, whatever the data."""
    cells = rows.groupBy(F.expr(f"cast(({hash_} & {size - 1}) >> 6 as int)").alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({hash_} & 63 as int))")).alias("bits"))
    found = cells.toArrow()  # size / 64 rows at most.
    bits = np.zeros(size // 64, np.uint64)
    bits[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def is_set(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    low = value & np.uint64(64 * len(bits) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def texts_of(docs: DataFrame, rows: DataFrame, size: int = 1 << 22) -> DataFrame:
    """``rows`` (id, hash, ...) joined with ``docs`` (id, hash, text); most texts that no row asks for stay unshuffled."""
    bits = bits_of(rows, "hash", size)

    def asked_for(hashes: pa.Array) -> pa.Array:
        return pa.array(is_set(bits, hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    texts = docs.where(F.arrow_udf(asked_for, "boolean")("hash")).withColumnsRenamed({"id": "text_id", "hash": "text_hash"})
    return texts.join(rows, (F.col("text_hash") == F.col("hash")) & F.col("text_id").eqNullSafe(F.col("id"))).drop("text_id", "text_hash")
