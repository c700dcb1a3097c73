"""What a comparison's outcomes mean for each item, and for each of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import utf16_length

#: Sources that one retirement names at most, and the length of its words, in UTF-16 units.
SOURCES, WORDS = 10, 2000


def item_decisions(rows: DataFrame, after: DataFrame, words: Column | None = None) -> DataFrame:
    """(subject, decision, why, n_sources): what becomes of every item of the open `rows` (subject, outcome, source, ...) once they are read.

    `after`: the comparison measured again, (subject, open, on_current_page). In this order: an item with a row `not found` is the user's (`his`);
    one with any other outcome than `removed` stays (`stays`); one that has a row in `after` that is not open is `kept`, as it is cited on a current page,
    and so is one that `after` says is on a page of the current set; one whose removal shows on more than 10 places, or whose `words` (of a
    row, the longest counts) run past 2,000 UTF-16 units, is his again; else it is to `retire`. Null flags say nothing; null sources are no place; subjects of
    `after` alone take no part, nor do null ones.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    length = F.lit(0) if words is None else F.max(F.coalesce(utf16_length(words), F.lit(0)))
    g = rows.where("subject is not null").groupBy("subject").agg(F.bool_or(F.col("outcome") == "not found").alias("lost"), F.bool_or(~F.coalesce(F.col("outcome") == "removed", F.lit(False))).alias("other"), F.countDistinct("source").alias("n_sources"), length.alias("length"))
    a = after.where("subject is not null").groupBy("subject").agg(F.bool_or(~F.coalesce("open", F.lit(True))).alias("current"), F.bool_or(flag("on_current_page")).alias("on_set"))
    j = g.join(a, "subject", "left")
    why = (
        F.when(flag("lost"), "a row not found").when(F.col("other"), None).when(flag("current"), "cited on a current page").when(flag("on_set"), "cited on another page of the current set")
        .when(F.col("n_sources") > SOURCES, "shows on more places than one retirement names").when(F.col("length") > WORDS, "runs past the length of a retirement")
    )
    decision = F.when(flag("lost"), "his").when(F.col("other"), "stays").when(flag("current") | flag("on_set"), "kept").when(why.isNotNull(), "his").otherwise("retire")
    return j.select("subject", decision.alias("decision"), why.alias("why"), "n_sources")


def row_categories(rows: DataFrame, decisions: DataFrame, refused: DataFrame, carried: bool) -> DataFrame:
    """`rows` (subject, open, answer, outcome, ...) with a `category`, one of nine that no two share.

    A row that is not open is `carried` if it read the `same` and a carry ran, else `pass`. An open one is `recited` or `updated`; `left` if it was not
    found; and, removed, `removed` where its item is retired, `refused` where that was refused (`refused`: subject), `held` where the item is the
    user's, else `kept`. An open row without an outcome has none. A null `open` is open.
    """
    d = decisions.select("subject", "decision")
    r = refused.select("subject", F.lit(True).alias("_refused")).distinct()
    j = rows.join(d, "subject", "left").join(r, "subject", "left")
    shut = ~F.coalesce("open", F.lit(True))
    category = (
        F.when(shut & (F.lit(carried) & F.coalesce(F.col("answer") == "same", F.lit(False))), "carried").when(shut, "pass").when(F.col("outcome").isin("recited", "updated"), F.col("outcome")).when(F.col("outcome") == "not found", "left")
        .when(F.col("outcome") != "removed", None).when(F.col("outcome").isNull(), None).when(F.coalesce("_refused", F.lit(False)), "refused").when(F.col("decision") == "retire", "removed").when(F.col("decision") == "his", "held").otherwise("kept")
    )
    return j.withColumn("category", category).drop("decision", "_refused")


def open_rows_agree(categories: DataFrame) -> DataFrame:
    """(open_rows, sorted, agrees): do the categories of the open rows add up to their number?"""
    is_open = F.coalesce("open", F.lit(True))
    open_ones = ("recited", "updated", "left", "removed", "refused", "held", "kept")
    return categories.agg(F.count_if(is_open).alias("open_rows"), F.count_if(is_open & F.coalesce(F.col("category").isin(*open_ones), F.lit(False))).alias("sorted")).withColumn("agrees", F.col("open_rows") == F.col("sorted"))
