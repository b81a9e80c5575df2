"""Insert-or-update of a batch into a keyed target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str],
           on_insert: Mapping[str, Column] | None = None, one_pass: bool = False) -> DataFrame:
    """The target after the batch.

    Both sides hold each key once. Columns of the batch replace those of a
    matching target row; target columns the batch lacks keep their value on
    update and take ``on_insert`` (else null) on insert. The large side is only
    ever the left of a left or semi join: a batch small enough to be broadcast
    leaves it unshuffled. ``one_pass`` is for batches beyond that: one full
    outer join, which reads and moves each side once.
    """
    on_insert = on_insert or {}
    fresh = [c for c in batch.columns if c not in keys]
    changes = batch.select(*keys, F.struct(F.lit(True).alias("_present"), *fresh).alias("_new"))

    def inserted(c: str) -> Column:
        return on_insert.get(c, F.lit(None)).cast(target.schema[c].dataType)

    def updated(c: str) -> Column:
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c)

    if one_pass:
        joined = target.withColumn("_known", F.lit(True)).join(changes, list(keys), "full_outer")
        return joined.select(*[updated(c) if c in batch.columns
                               else F.when(F.col("_known"), F.col(c)).otherwise(inserted(c)).alias(c) for c in target.columns])
    known = target.select(*keys).join(batch.select(*keys), list(keys), "left_semi")
    added = batch.join(known, list(keys), "left_anti")
    return target.join(changes, list(keys), "left").select(*[updated(c) for c in target.columns]).unionByName(
        added.select(*[F.col(c) if c in added.columns else inserted(c).alias(c) for c in target.columns]))
