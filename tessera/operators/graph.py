"""Order gates, reachability and prefix matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def waits(units: DataFrame, passes: str, position: str, discipline: str, rank: str) -> DataFrame:
    """(pass, waits_on): a pass waits on an earlier one of its discipline whose lowest class is under its own highest.

    Only one row for each pass and discipline meets another, by an equi-join on the discipline.
    """
    each = units.groupBy(passes, position, discipline).agg(F.min(rank).alias("low"), F.max(rank).alias("high"))
    p, q = each.alias("p"), each.alias("q")
    j = p.join(q, (F.col(f"p.{discipline}") == F.col(f"q.{discipline}")) & (F.col(f"q.{position}") < F.col(f"p.{position}")) & (F.col("q.low") < F.col("p.high")))
    return j.select(F.col(f"p.{passes}").alias("pass"), F.col(f"q.{passes}").alias("waits_on")).distinct()


def reachable(edges: DataFrame, source: str, target: str, most: int = 64) -> DataFrame:
    """(source, target) of all paths, cycle-safe, by doubling: as many joins as the logarithm of the longest path.

    Each round is checkpointed where a checkpoint folder is set.
    """
    reach, n = edges.select(source, target).distinct(), -1
    keep = edges.sparkSession.sparkContext.getCheckpointDir() is not None
    for _ in range(most):
        hop = reach.alias("a").join(reach.alias("b"), F.col(f"a.{target}") == F.col(f"b.{source}")).select(F.col(f"a.{source}").alias(source), F.col(f"b.{target}").alias(target))
        reach = reach.union(hop).distinct()
        reach = reach.checkpoint() if keep else reach.persist()
        now = reach.count()
        if now == n:
            return reach
        n = now
    raise ValueError(f"reachability not settled after {most} doublings")


def levels(edges: DataFrame, nodes: DataFrame, node: str, before: str, most: int = 1000) -> DataFrame:
    """The order level of each node after all it waits on; a cycle refuses.

    A node's level is one over the largest of those it waits on: each round raises levels along the edges and is
    checkpointed (or kept in memory where no folder is set), until none rises; more rounds than nodes mean a cycle.
    """
    spark = edges.sparkSession
    keep = spark.sparkContext.getCheckpointDir() is not None
    cut = lambda df: df.checkpoint() if keep else df.persist()
    edges = cut(edges.select(node, before).distinct())
    now = cut(nodes.select(node).distinct().withColumn("level", F.lit(0)))
    limit = min(most, now.count())
    for _ in range(limit + 1):
        raised = edges.join(now.select(F.col(node).alias(before), (F.col("level") + 1).alias("_up")), before).groupBy(node).agg(F.max("_up").alias("_up"))
        nxt = cut(now.join(raised, node, "left").select(node, F.greatest("level", F.coalesce("_up", F.lit(0))).alias("level"), (F.coalesce("_up", F.lit(0)) > F.col("level")).alias("_rose")))
        rose = nxt.where("_rose").limit(1).count()
        now = nxt.select(node, "level")
        if not rose:
            return now
    raise ValueError("a cycle of waits")


def covered_prefix(code: Column) -> Column:
    """The digits that a six-digit package code covers: two, four or three of them if it is broad, else all six."""
    return F.when(~code.rlike("^[0-9]{6}$") | ~code.endswith("00"), code).when(code.endswith("0000"), F.substring(code, 1, 2)).when(F.substring(code, 4, 1) != "0", F.substring(code, 1, 4)).otherwise(F.substring(code, 1, 3))


def prefix_join(items: DataFrame, code: str, packages: DataFrame, package_code: str) -> DataFrame:
    """Items with the packages that cover their code, by an equi-join on the prefixes that a code can have."""
    keyed = items.withColumn("_p", F.explode(F.array(*[F.substring(F.col(code), 1, k) for k in (2, 3, 4)], F.col(code))))
    return keyed.join(packages.withColumn("_p", covered_prefix(F.col(package_code))), "_p").drop("_p")


def waits_of_reviews(units: DataFrame) -> DataFrame:
    """(pass, waits_on) of `units` (pass, position, unit, continues, trade): a pass of reviews waits on each earlier one that holds a unit one of
    its units continues, or a unit of a trade it holds.

    Units meet by what is continued, and passes by their trades, one row for each pass and trade; null trades and units meet nothing. Only
    earlier passes are waited on, so there is no cycle. Rows that repeat count once.
    """
    p, q = units.alias("p"), units.select("pass", "position", "unit").where("unit is not null").alias("q")
    continued = p.where(F.col("p.continues").isNotNull()).join(q, (F.col("p.continues") == F.col("q.unit")) & (F.col("q.position") < F.col("p.position")))
    each = units.where("trade is not null").select("pass", "position", "trade").distinct()
    a, b = each.alias("p"), each.alias("q")
    shared = a.join(b, (F.col("p.trade") == F.col("q.trade")) & (F.col("q.position") < F.col("p.position")))
    # what a pass meets in one unit or trade is one row of the shuffle; those are told apart where the pass is
    row = lambda met, key: met.groupBy(F.col("p.pass").alias("pass"), F.col(key).alias("_met")).agg(F.collect_set("q.pass").alias("waits_on")).select("pass", "waits_on")
    rows = row(continued, "q.unit").union(row(shared, "q.trade")).repartition("pass")
    return rows.select("pass", F.explode("waits_on").alias("waits_on")).distinct()
