"""Numbering and packing of units into passes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordinals import folded, numbered


def even_split(df: DataFrame, key: list[str], order: list[str], most: int = 12) -> DataFrame:
    """Parts of at most `most` rows, sizes within one of each other, the earlier ones larger; from ordinals and counts alone."""
    i, n = F.col("_i") - 1, F.col("_n")
    parts = F.ceil(n / most)
    base, extra = F.floor(n / parts), n % parts
    big = extra * (base + 1)
    part = F.when(i < big, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - big) / base))
    rows = numbered(df, order, key, "_i").alias("r")
    sizes = rows.groupBy(*key).agg(F.max("_i").alias("_n")).alias("n")
    joined = rows.join(sizes, [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]).select("r.*", "n._n")
    return joined.withColumn("part", part.cast("long")).drop("_i", "_n")


def batches(df: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """Fixed batches in order."""
    return numbered(df, order, key, "_i").withColumn("batch", F.floor((F.col("_i") - 1) / size).cast("long")).drop("_i")


def fold_small(parts: DataFrame, key: list[str], order: str, size: str, least: int = 3, most: int = 12) -> DataFrame:
    """Adjoining parts joined while either is under `least` and both fit in `most`; (key, order, pass).

    The state is what the open pass has built: nothing, 0 to `most`, or more than that, where nothing can join.
    """

    def step(state, n):
        built = state - 1
        joins = (state > 0) & (np.minimum(built, n) < least) & (built + n <= most)
        return np.minimum(np.where(joins, built + n, n), most + 1) + 1, ~joins

    return folded(parts.select(*key, order, size), [order], key, [F.greatest(F.col(size).cast("long"), F.lit(0))], most + 3, step, "pass").drop(size)


def bins(groups: DataFrame, key: list[str], order: str, reviews: str, units: str, most_reviews: int = 8, most_units: int = 10) -> DataFrame:
    """Whole groups put in the open bin while both limits hold, else in the next; (key, order, bin). The state is what the open bin holds of both."""
    wide = most_units + 2

    def step(state, r, u):
        have_r, have_u = (state - 1) // wide, (state - 1) % wide
        fits = (state > 0) & (have_r + r <= most_reviews) & (have_u + u <= most_units)
        new_r, new_u = np.where(fits, have_r + r, r), np.where(fits, have_u + u, u)
        return np.minimum(new_r, most_reviews + 1) * wide + np.minimum(new_u, most_units + 1) + 1, ~fits

    amounts = [F.greatest(F.col(c).cast("long"), F.lit(0)) for c in (reviews, units)]
    return folded(groups.select(*key, order, reviews, units), [order], key, amounts, 1 + (most_reviews + 2) * wide, step, "bin").drop(reviews, units)


def bind_ids(rows: DataFrame, key: str, part: str, order: str, ledger: DataFrame, plan: DataFrame) -> DataFrame:
    """A row keeps its ledger number, else its plan number, else the next after the part's high-water mark in order.

    `ledger` and `plan` are (key, part, number). A plan number yields to a row that the ledger binds to it.
    """
    bound = rows.join(ledger.select(key, F.col("number").alias("_l")), key, "left")
    free = plan.join(ledger.select(part, "number"), [part, "number"], "left_anti").join(ledger.select(key), key, "left_anti")
    bound = bound.join(free.select(key, F.col("number").alias("_p")), key, "left").withColumn("number", F.coalesce("_l", "_p"))
    high = ledger.select(part, "number").union(plan.select(part, "number")).groupBy(part).agg(F.max("number").alias("_h"))
    w = Window.partitionBy(part, F.col("number").isNull()).orderBy(order)
    fresh = F.coalesce("_h", F.lit(0)) + F.row_number().over(w)
    return bound.join(high, part, "left").withColumn("bound", F.when(F.col("_l").isNotNull(), "ledger").when(F.col("_p").isNotNull(), "plan").otherwise("new")).withColumn("number", F.coalesce("number", fresh).cast("long")).drop("_l", "_p", "_h")
