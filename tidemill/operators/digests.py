"""Compare two tables by digests that do not depend on the order of rows, part by part, so that only parts that differ are read.

A part's digest is its number of rows and two sums over hashes of whole rows, which add up in any order and grouping: digests
combine before the shuffle, and one row per part and side moves. Levels go from coarse to fine, as from days to ranges of
keys within a day; each level looks only into the parts in which the one above differs, and rows are compared in the last ones.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .signed import signed_changes


def digests(df: DataFrame, levels: Mapping[str, str], sign: int = 1) -> DataFrame:
    """Per part (SQL expressions by name): signed ``rows``, ``total`` and the exclusive or ``mix`` of the rows' hashes."""
    row = F.xxhash64(*df.columns)
    parts = [F.expr(expression).alias(name) for name, expression in levels.items()]
    hashed = df.select(*parts, row.alias("_h"), F.xxhash64(F.lit(7), *df.columns).alias("_g"))
    return hashed.groupBy(*levels).agg(F.sum(F.lit(sign)).cast("long").alias("rows"), F.sum(sign * F.col("_h").cast("decimal(38,0)")).alias("total"),
                                       F.bit_xor("_g").alias("mix"))


def _inside(df: DataFrame, parts: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """The rows of ``df`` in some parts; plain equality with a stand-in for null, so that folders of a part are pruned."""
    marked = df.select("*", *[F.coalesce(F.expr(expression).cast("string"), F.lit("\0")).alias(f"_{name}") for name, expression in levels.items()])
    wanted = parts.select(*[F.coalesce(F.col(name).cast("string"), F.lit("\0")).alias(f"_{name}") for name in levels])
    return marked.join(wanted, [f"_{name}" for name in levels], "left_semi").select(df.columns)


def differing_parts(left: DataFrame, right: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """The finest parts in which two tables of the same columns differ, level by level."""
    right = right.select(left.columns)
    parts: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        here = dict(list(levels.items())[:depth])
        above = dict(list(levels.items())[:depth - 1])
        sides = [digests(df if parts is None else _inside(df, parts, above), here, sign) for df, sign in ((left, 1), (right, -1))]
        sums = sides[0].union(sides[1]).groupBy(*here).agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bit_xor("mix").alias("mix"))
        parts = stored(sums.where("rows <> 0 or total <> 0 or mix <> 0").select(*here), "differing")
    return parts


def differing_rows(left: DataFrame, right: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """The rows of either table that the other lacks, with ``sign`` -1 for the left and 1 for the right; rows count as often as they occur.

    ``levels`` names the parts from coarse to fine by SQL expressions over the columns; a null is a part like any other.
    Equal tables give no rows, and after the first level neither is read again.
    """
    right = right.select(left.columns)
    parts = differing_parts(left, right, levels)
    if not parts.limit(1).count():
        return signed_changes(left.limit(0), right.limit(0))
    return signed_changes(*[_inside(df, parts, levels) for df in (left, right)])


def key_range(keys: str, ranges: int = 64) -> str:
    """A level: which of some ranges of hashed keys a row is in."""
    return f"cast(pmod(xxhash64({keys}), {ranges}) as int)"
