"""Mixing sources to target weights: entropy balancing by distributed Newton steps, then whole copies.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .numbering import numbered

#: A document is taken so many times at most, and a source's target is at most so many times its size.
MOST = 3
_KEY, _SIZE = "__tidemill_source", "__tidemill_size"
_EXACT = "decimal(38,6)"


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _total(value: Column) -> Column:
    """A sum of doubles that does not depend on the order of the rows."""
    return F.sum(value.cast(_EXACT)).cast("double")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``target`` to (source key, number of rows, size): the total shared by weight, at most MOST times each size.

    Sources take the weights in turn, in order of their key. What a capped source cannot take goes to the others
    by weight; each pass caps more sources, so the passes end.
    """
    placed = numbered(sources, [F.col(_KEY).asc()], "__tidemill_turn")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("__tidemill_turn", F.lit(len(weights))) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).drop("__tidemill_turn")
    cap, share, capped = F.col("source_size") * F.lit(float(MOST)), 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(share)
        seen = placed.agg(F.count_if(full), F.sum("source_size"), F.sum(F.when(full, F.col("source_size")).otherwise(0)),
                          F.sum(F.when(~full, F.col("weight")).otherwise(0))).first()
        if seen[0] == capped or not seen[3]:
            break
        capped, share = seen[0], (seen[1] - MOST * seen[2]) / seen[3]
    return placed.withColumn("target", F.least(cap, F.col("weight") * F.lit(share)))


def tilt(cells: DataFrame, goals: DataFrame, steps: int = 60, near: float = 1e-9) -> DataFrame:
    """``goals`` with ``lam``: the exponent at which each source's expected words meet its target.

    The rate of a document is min(MOST, exp(lam * x)), x its size over the mean size of its source: of all rates
    with the right expected words and none above MOST it has the least relative entropy to taking each document
    once. Each step adds up the gradient and the curvature of the convex dual per source over ``cells`` and
    moves by Newton, or halves the known bracket where Newton would leave it. The state is one row per source,
    written after each step.
    """
    state = stored(goals.withColumns({
        "mean": F.when(F.col("source_size") > 0, F.col("source_size") / F.col("filled")).otherwise(F.lit(1.0)),
        "lam": F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)),
        "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"),
        "fixed": (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * F.lit(float(MOST)) * (1 - 1e-12))}), "tilt")
    x = F.col(_SIZE) / F.col("mean")
    rate = F.exp(F.col("lam") * x)
    words = F.col("n") * F.col(_SIZE)
    for _ in range(steps):
        sums = cells.join(state.select(_KEY, "lam", "mean").where(~F.col("fixed")), _KEY).groupBy(_KEY).agg(
            _total(words * F.least(rate, F.lit(float(MOST)))).alias("got"),
            _total(F.when(rate < MOST, words * x * rate).otherwise(0.0)).alias("slope"))
        off = F.col("got") - F.col("target")
        low = F.when(off < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(off >= 0, F.col("lam")).otherwise(F.col("high"))
        moved = (state.join(sums, _KEY, "left").withColumns({"low": low, "high": high, "off": F.abs(off) / F.col("target"),
                 "next": F.when(F.col("slope") > 0, F.col("lam") - off / F.col("slope"))}))
        # Outside the bracket: its middle, or a doubled distance while one end is open.
        inside = (F.col("next") > F.coalesce("low", F.lit(float("-inf")))) & (F.col("next") < F.coalesce("high", F.lit(float("inf"))))
        middle = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).when(
            F.col("low").isNotNull(), F.col("low") + F.abs("low") + 1).otherwise(F.col("high") - F.abs("high") - 1)
        done = F.col("fixed") | (F.col("off") <= near)
        state = stored(moved.withColumns({
            "lam": F.when(done, F.col("lam")).when(inside, F.col("next")).otherwise(middle), "fixed": done}).drop("got", "slope", "off", "next"), "tilt")
        if not state.where(~F.col("fixed")).limit(1).count():
            break
    return state


def _whole(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """``cells`` with ``copies``: how often the documents of a cell are taken together.

    Rates are rounded along the sizes of a source so that the running number of copies follows its expectation;
    what is then missing or too much, half the longest document at most, is settled with the shortest documents.
    """
    top = (F.col("target") >= F.col("source_size") * F.lit(float(MOST)) * (1 - 1e-12))
    rate = F.when(top, F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.col("lam") * F.col(_SIZE) / F.col("mean"))))
    rated = cells.join(goals.select(_KEY, "source_size", "target", "lam", "mean"), _KEY).withColumn("expected", (F.col("n") * rate).cast(_EXACT))
    along = Window.partitionBy(_KEY).orderBy(_SIZE)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rated = rated.withColumn("upto", F.round(F.sum("expected").over(upto)).cast("long"))
    rated = rated.withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0)))
    rated = rated.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), F.col("n") * MOST))
    rest = F.round("target").cast("long") - F.sum(F.col("copies") * F.col(_SIZE)).over(Window.partitionBy(_KEY))
    rated = rated.withColumn("rest", rest)
    room = F.when(F.col("rest") >= 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
    rated = rated.withColumn("room", F.when(F.col(_SIZE) > 0, room).otherwise(0))
    used = F.coalesce(F.sum(F.col("room") * F.col(_SIZE)).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rated = rated.withColumn("used", used)
    fit = F.when(F.col(_SIZE) > 0, F.expr(f"(abs(rest) - used) div {_SIZE}")).otherwise(0)
    more = F.greatest(F.lit(0), F.least(fit, F.col("room"))) * F.signum("rest").cast("long")
    return rated.select(_KEY, _SIZE, "n", (F.col("copies") + more).alias("copies"), "source_size", "target")


def mix(df: DataFrame, source: Column, size: Column, row_hash: Column, weights: tuple[int, ...] = (1, 2, 3), spread: int = 1024) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``copies``: how often the mix takes each row.

    Sources without any words have target 0 and rows without words keep one copy. A null source is a source of
    its own, last in order; an empty table stays empty. Rows alike in source, size and ``row_hash`` are
    interchangeable. Copies of a cell (source, size) go to its rows by hash, over ``spread`` sub-cells, so that a
    cell with a third of all rows is not ranked in one task. Input columns with the new names are replaced.
    """
    kept = [c for c in df.columns if c not in ("size", "source_size", "target", "copies")]
    # "0" before and "1" for null sorts null last and leaves the others in code-point order.
    key = F.when(source.isNotNull(), F.concat(F.lit("0"), source)).otherwise(F.lit("1"))
    rows = df.withColumns({_KEY: key, _SIZE: size, "__tidemill_hash": row_hash})
    rows = rows.select(*kept, _KEY, _SIZE, "__tidemill_hash", F.pmod("__tidemill_hash", F.lit(spread)).alias("__tidemill_sub"))
    subs = stored(rows.groupBy(_KEY, _SIZE, "__tidemill_sub").agg(F.count("*").alias("m")), "subcells")
    cells = stored(subs.groupBy(_KEY, _SIZE).agg(F.sum("m").alias("n")), "cells")
    sources = cells.groupBy(_KEY).agg(F.sum(F.col("n") * F.col(_SIZE)).alias("source_size"),
                                      F.sum(F.when(F.col(_SIZE) > 0, F.col("n")).otherwise(0)).alias("filled"))
    whole = stored(_whole(cells, tilt(cells, targets(sources, weights))), "copies")
    inside = Window.partitionBy(_KEY, _SIZE).orderBy("__tidemill_sub")
    upto = F.expr("(copies * cast(sum(m) over (partition by {k}, {s} order by __tidemill_sub) as decimal(38,0))) div n".format(k=_KEY, s=_SIZE))
    taken = subs.join(whole, [_KEY, _SIZE]).withColumn("upto", upto.cast("long"))
    taken = taken.withColumn("take", F.col("upto") - F.coalesce(F.lag("upto").over(inside), F.lit(0)))
    taken = taken.select(_KEY, _SIZE, "__tidemill_sub", F.col("m").alias("__tidemill_m"), F.col("take").alias("__tidemill_take"), "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(_KEY, _SIZE, "__tidemill_sub").orderBy("__tidemill_hash"))
    joined = rows.withColumn("__tidemill_rank", rank).join(taken, [_KEY, _SIZE, "__tidemill_sub"])
    copies = F.expr("__tidemill_take div __tidemill_m") + (F.col("__tidemill_rank") <= F.expr("__tidemill_take % __tidemill_m")).cast("long")
    return joined.select(*kept, F.col(_SIZE).alias("size"), "source_size", "target", copies.alias("copies"))
