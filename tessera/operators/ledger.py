"""State of units in an append-only run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(log: DataFrame, key: list[str], order: list[str], value: str, name: str = "state") -> DataFrame:
    """A10: the value on each key's last line: one partial aggregate, no sort of the log."""
    return log.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(name))


def high_water(log: DataFrame, key: Column, number: str) -> DataFrame:
    """The largest number of each id component."""
    return log.groupBy(key.alias("part")).agg(F.max(number).alias("high"))


def legality(log: DataFrame, key: list[str], order: list[str], kind: str, verified: Column, mismatch: Column, dispatch: Column) -> DataFrame:
    """Each verified line with whether it is legal: the unit's first, or after a mismatch with a dispatch since.

    Windows are over one unit's lines; a unit has few.
    """
    own = Window.partitionBy(*key).orderBy(*order)
    runs = log.withColumn("_d", F.sum(dispatch.cast("int")).over(own))
    lines = runs.where(verified).withColumn("_m", F.lag(mismatch).over(own)).withColumn("_p", F.lag("_d").over(own))
    return lines.withColumn("legal", F.col("_m").isNull() | (F.col("_m") & (F.col("_d") > F.col("_p")))).drop("_d", "_m", "_p")


def read_number(log: DataFrame, key: list[str], order: list[str], dispatch: Column) -> DataFrame:
    """Dispatch lines of the unit up to each line."""
    return log.withColumn("read", F.sum(dispatch.cast("int")).over(Window.partitionBy(*key).orderBy(*order)))


def since_marker(log: DataFrame, key: list[str], order: list[str], marker: Column) -> DataFrame:
    """Lines after the key's last marker (all lines, where it has none), by one aggregate and a join."""
    at = F.struct(*order)
    last = log.where(marker).groupBy(*key).agg(F.max(at).alias("_last"))
    return log.join(last, key, "left").where(F.col("_last").isNull() | (at > F.col("_last"))).drop("_last")
