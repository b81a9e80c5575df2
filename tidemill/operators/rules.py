"""Row rules: drop violations, count them apart or in the pass that writes, tag rejections with a reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def drop_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Keep the rows every rule holds for; a null outcome counts as a violation."""
    return df.where(reduce(lambda a, b: a & b, rules.values()))


def rule_metrics(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per rule the rows kept and dropped, all rules in one pass."""
    outcome = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.coalesce(rule, F.lit(False)).alias("ok"))
        for name, rule in rules.items()
    ])).alias("o")
    return df.select(outcome).groupBy("o.rule").agg(
        F.count_if(F.col("o.ok")).alias("kept"),
        F.count_if(~F.col("o.ok")).alias("dropped"),
    )


def observe_rules(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows every rule holds for, and how many each rule keeps and drops, counted while the rows pass.

    The counts are there after the first action on the rows, such as their write; no further scan is made.
    """
    seen = Observation()
    counts = [F.count_if(F.coalesce(rule, F.lit(False)) == kept).alias(f"{name}:{side}") for name, rule in rules.items()
              for side, kept in (("kept", True), ("dropped", False))]
    return drop_violations(df.observe(seen, *counts), rules), seen


def observed_counts(spark: SparkSession, seen: Observation, rules: Mapping[str, Column]) -> DataFrame:
    """The counts of observed rows in the shape of ``rule_metrics``; to be called after their action."""
    counts = seen.get
    return spark.createDataFrame([(name, counts[f"{name}:kept"], counts[f"{name}:dropped"]) for name in rules], "rule string, kept long, dropped long")


def tag_rejections(df: DataFrame, reasons: Sequence[tuple[str, Column]],
                   name: str = "rejection_reason") -> DataFrame:
    """Add the first reason whose condition is true, else null."""
    chain = F
    for reason, condition in reasons:
        chain = chain.when(condition, F.lit(reason))
    return df.withColumn(name, chain)
