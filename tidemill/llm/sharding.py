"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

#: Modulus of the round function; products of two residues fit a signed 64-bit integer.
PRIME = (1 << 31) - 1


def round_keys(seed: int, rounds: int = 4) -> list[tuple[int, int, int]]:
    """Three residues per round, from the seed by a linear congruence."""
    keys, x = [], seed % PRIME
    for _ in range(rounds):
        triple = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            triple.append(1 + x % (PRIME - 1))
        keys.append(tuple(triple))
    return keys


def permute(values: np.ndarray, total: int, seed: int) -> np.ndarray:
    """A bijection of 0..total-1, for an array of its members.

    Two halves below ``side`` pass the rounds; a result of ``total`` or more is sent through again until it
    falls inside, which ends because the rounds permute the whole square.
    """
    side = math.isqrt(max(total - 1, 0)) + 1
    out = np.asarray(values, np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // side, out[todo] % side
        for add, factor, shift in round_keys(seed):
            x = (right + add) % PRIME
            x = x * x % PRIME
            x = (x * factor + shift) % PRIME
            x = x * x % PRIME
            left, right = right, (left + x) % side
        out[todo] = left * side + right
        todo = todo[out[todo] >= total]
    return out


def permuted(number: Column, total: int, seed: int) -> Column:
    """``permute`` as a column function."""
    def walk(numbers: pa.Array) -> pa.Array:
        return pa.array(permute(numbers.to_numpy(zero_copy_only=False), total, seed), pa.int64())
    return F.arrow_udf(walk, "long")(number)


def shard(df: DataFrame, order: list[Column], shards: int, seed: int = 20, shard_name: str = "shard", slot_name: str = "slot") -> DataFrame:
    """``df`` with the shard and the place in it of every row; shard sizes differ by one row at most.

    ``order`` fixes the row numbers: rows that tie in it must be interchangeable to the caller. The place
    of a row in the shuffled whole is the permuted number p; its shard is p mod ``shards``, its slot
    p div ``shards``. Nulls sort first; an empty table stays empty; input columns with the new names are
    replaced. Any number of machines or partitions gives the same result.
    """
    rows = numbered(df, order, "__tidemill_row")
    total = rows.count()
    place = F.col("__tidemill_place")
    rows = rows.drop(shard_name, slot_name).withColumn("__tidemill_place", permuted(F.col("__tidemill_row"), total, seed))
    return (rows.withColumn(shard_name, F.pmod(place, F.lit(shards)).cast("int"))
            .withColumn(slot_name, F.expr(f"__tidemill_place div {int(shards)}"))
            .drop("__tidemill_row", "__tidemill_place"))
