"""Connected components of a link table by contraction, and rounds of leads that join up groups before all pairs meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Renamings that one plan puts together.
_AT_ONCE = 6


def _contract(edges: DataFrame, seed: int) -> DataFrame:
    """(old, new): every node takes the name of that node, among itself and its neighbours, that comes first in a shuffled order."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    first = both.select("a", "b", F.xxhash64("b", F.lit(seed)).alias("h")).groupBy("a").agg(F.min("h").alias("h"), F.min_by("b", "h").alias("b"))
    own = F.xxhash64("a", F.lit(seed))
    return stored(first.select(F.col("a").alias("old"), F.when((F.col("h") < own), F.col("b")).otherwise(F.col("a")).alias("new")), "names")


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``: the smallest node it can reach.

    Each round gives a node the name of the first of its neighbourhood in an order that is shuffled anew every second
    round, and redraws the links between names until none is left. The nodes shrink by a constant factor a round whatever
    their numbers are, so a chain takes rounds by the logarithm of its length, and a star two. Minima combine before the shuffle,
    links and names stay distributed, and every round is written to the shared folder. A null end is no link; a link of a node
    with itself makes it a component; an empty table gives no nodes.
    """
    edges = stored(links.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna(), "edges")
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        steps.append(names := _contract(edges, len(steps) // 2))
        renamed = edges.join(names, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
        renamed = renamed.join(names, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        edges = stored(renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    # Put together from the last, smallest renaming to the first.
    names = steps.pop().withColumnsRenamed({"old": "node", "new": "name"})
    while steps:
        for _ in range(min(_AT_ONCE, len(steps))):
            step = steps.pop()
            names = step.join(names, F.col("new") == F.col("node"), "left").select(F.col("old").alias("node"), F.coalesce("name", "new").alias("name"))
        names = stored(names, "names")
    least = names.groupBy("name").agg(F.min("node").alias("component"))
    return names.join(least, "name").select("node", "component")


def with_groups(buckets: DataFrame, names: DataFrame | None) -> DataFrame:
    """``buckets`` (token, node, ...) with the ``group`` of each node: its component in ``names``, or itself."""
    if names is None:
        return buckets.withColumn("group", F.col("node"))
    return buckets.join(names, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")


def mixed(grouped: DataFrame) -> DataFrame:
    """The rows of ``grouped`` (token, node, group, ...) whose token still holds two groups."""
    tokens = grouped.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("token")
    return grouped.join(tokens, "token")


def leads(grouped: DataFrame, seed: int, place: str | None = None) -> DataFrame:
    """(a, b): each node of a token that holds two groups, and the lead of another group with which it shares most tokens.

    The lead of a token is its first node by ``place``, a number from 0 below 2^23, if that is given, and else or among equals in
    an order shuffled by ``seed``. A node has one lead at most, so the pairs do not outgrow the nodes however many share a token.
    """
    h = F.xxhash64("node", F.lit(seed))
    if place:
        h = F.shiftleft(F.col(place).cast("long"), 40) + F.shiftrightunsigned(h, 24)
    order = grouped.withColumn("h", h).groupBy("token").agg(
        F.min_by("node", "h").alias("lead"), F.min_by("group", "h").alias("lead_group"), F.min("group").alias("x"), F.max("group").alias("y"))
    met = grouped.join(order.where("x <> y").drop("x", "y"), "token").where(F.col("group") != F.col("lead_group"))
    shared = met.groupBy("node", "lead").agg(F.count("*").alias("n"))
    return shared.groupBy("node").agg(F.max_by("lead", "n").alias("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
