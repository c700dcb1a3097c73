"""References carried forward onto the pages that replace theirs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import held


def current_pages(steps: DataFrame) -> DataFrame:
    """(page, at, end) of every page that `steps` (page, next_page, same) replaces: where it is now, and how the way there ends.

    A page's step leads to the one that takes its place; `same` says that nothing changed. The way goes on while steps are the same:
    end is `current` at a page that nothing replaces, `changed` before a step that is not, and `cycle` where it never ends. Every
    round doubles the length of the ways, and is written, so that lineage stays short: as many joins as the logarithm of the longest.
    A page has one step; of several, the one to the smallest page counts. Null pages are passed over, a null `same` is false.
    """
    one = steps.where("page is not null and next_page is not null").groupBy("page").agg(F.min(F.struct("next_page", F.coalesce("same", F.lit(False)).alias("same"))).alias("s")).select("page", "s.*")
    one = held(one)
    stops = one.where("not same").select(F.col("page").alias("stop"))
    ways = one.select("page", F.when(F.col("same"), F.col("next_page")).otherwise(F.col("page")).alias("at"))
    now = held(ways)
    most = 2 + math.ceil(math.log2(1 + one.count()))
    for _ in range(most):
        a, b = now.alias("a"), now.alias("b")
        hop = a.join(b, F.col("a.at") == F.col("b.page"), "left")
        nxt = hop.select("a.page", F.coalesce("b.at", "a.at").alias("at"), (F.col("b.at").isNotNull() & (F.col("b.at") != F.col("a.at"))).alias("moved"))
        nxt = held(nxt)
        now = nxt.select("page", "at")
        if nxt.where("moved").isEmpty():
            break
    ends = now.join(stops, F.col("at") == F.col("stop"), "left").join(one.where("same").select(F.col("page").alias("on")), F.col("at") == F.col("on"), "left")
    return ends.select("page", "at", F.when(F.col("stop").isNotNull(), "changed").when(F.col("on").isNotNull(), "cycle").otherwise("current").alias("end"))


def carry_forward(references: DataFrame, steps: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, balance) of `references` (ref, subject, page, box) on pages that `steps` replaces, `ref` of any type that has an order; `there`: (subject, page) that are cited.

    outcomes: (ref, subject, page, box, to_page, outcome), one row for each reference: `left` one without a box, which names a whole sheet
    and is not carried; `not carried` where a step on the way changed, or the way is a cycle; `already there` where the subject is on the
    current page; else `carried`, to be written as (subject, to_page, box). A reference to a page that nothing replaces takes no part. Of
    references that would write the same, one each is carried and the others are already there.

    balance: (boxes, no_box, carried, already_there, not_carried, left, holds): what was to be carried against the sum of what became of it.
    """
    ways = current_pages(steps)
    on = references.join(ways, "page")
    known = there.where("subject is not null and page is not null").select("subject", F.col("page").alias("at"), F.lit(True).alias("_there")).distinct()
    on = on.join(known, ["subject", "at"], "left")
    # rows of one subject, current page and box end alike, so the first of them is the one that is carried
    first = F.row_number().over(Window.partitionBy("subject", "at", "box").orderBy(F.col("ref").asc_nulls_last())) == 1
    outcome = (
        F.when(F.col("box").isNull(), "left").when(F.col("end") != "current", "not carried").when(F.col("_there").isNotNull(), "already there")
        .when(F.col("subject").isNotNull() & first, "carried").otherwise("already there")
    )
    out = on.select("ref", "subject", "page", "box", F.when(F.col("end") == "current", F.col("at")).alias("to_page"), outcome.alias("outcome"))
    due = references.join(ways.select("page"), "page", "left_semi").agg(F.count("box").alias("boxes"), F.count_if(F.col("box").isNull()).alias("no_box"))
    n = out.agg(*[F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in ("carried", "already there", "not carried", "left")])
    total = F.col("carried") + F.col("already_there") + F.col("not_carried") + F.col("left")
    return out, due.join(F.broadcast(n)).withColumn("holds", total == F.col("boxes") + F.col("no_box"))
