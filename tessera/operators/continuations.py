"""Continuations of units, bound to passes in the order of their requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Units of one pass of reviews at most.
CAP = 10
#: Letters of the passes that continue a full one, after the pass itself.
LETTERS = "bcdefghijklmnopqrstuvwxyz"


class Passes:
    """One family of passes: the pass of reviews (place 0) and those of its continuations, one for each letter."""

    def __init__(self, units: int, cap: int):
        self.cap = cap
        self.units = [units] + [0] * len(LETTERS)
        self.planned = [True] + [False] * len(LETTERS)
        self.continues = [0] * (len(LETTERS) + 1)  # places of the passes whose units each continues, one bit each
        self.trades: list[set] = [set() for _ in self.units]
        self.full_for = 0  # places whose requests no pass can take any more

    def waits(self, later: int, earlier: int) -> bool:
        """Does a pass wait, directly or through others, for one before it? It waits for those whose units it continues, and those of a trade it holds."""
        seen, todo = 0, [later]
        while todo:
            at = todo.pop()
            for q in range(at):
                direct = self.continues[at] >> q & 1 or not self.trades[at].isdisjoint(self.trades[q])
                if direct and not seen >> q & 1:
                    if q == earlier:
                        return True
                    seen |= 1 << q
                    todo.append(q)
        return False

    def bind(self, place: int, trade) -> int | None:
        """The place that takes a continuation of a unit of pass `place`; None where none can."""
        if self.full_for >> place & 1:
            return None
        target = place if self.units[place] < self.cap else None
        for at in range(place + 1, len(self.units)):
            if target is not None:
                break
            if not self.planned[at] or self.units[at] < self.cap and self.waits(at, place):
                target = at
        if target is None:
            self.full_for |= 1 << place  # passes only fill up
            return None
        self.planned[target] = True
        self.units[target] += 1
        if target != place:
            self.continues[target] |= 1 << place
        if trade is not None:
            self.trades[target].add(trade)
        return target


def bind_continuations(requests: DataFrame, *, cap: int = CAP) -> DataFrame:
    """(pass, ordinal, review, number, continuation, bound_pass, outcome) of `requests` (pass, ordinal, review, units, trade, number_from).

    A request asks to go on with a review: with the review itself the first time, then with its last continuation. `pass`: the
    review's pass, which holds `units` units at first; `number_from`: the highest number that a continuation of this review has
    had before, whatever became of it (null: none). Requests are taken in the order of `ordinal` within the pass. A continuation
    goes on in the pass of the unit that it continues while that holds fewer than `cap` units (outcome `after its unit`); else in
    the first later pass of the family, by letter, that is not full and already waits for it (`carried`), or under the first letter
    that is not in use before that (`new letter`); else nowhere (`no pass left`): it has no number, and a later request of the
    review goes on with the same unit. Numbers run on from the review's highest. A null trade is no trade; null passes, reviews
    or ordinals ask for nothing; requests of one ordinal are taken in the order of their reviews; other columns are ignored.

    The rule depends on all requests before in a family, so each family's rows pass by in order, a batch at a time; what is kept
    meanwhile is 26 passes and one place for each review that has a continuation, at most 26 x `cap`.
    """
    asked = requests.where("pass is not null and review is not null and ordinal is not null")
    asked = asked.select(F.col("pass").cast("string").alias("pass"), F.col("ordinal").cast("long").alias("ordinal"), F.col("review").cast("string").alias("review"), F.col("units").cast("long").alias("units"), F.col("trade").cast("string").alias("trade"), F.col("number_from").cast("long").alias("number_from"))
    ordered = asked.repartition("pass").sortWithinPartitions("pass", "ordinal", "review")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, family, where = None, None, {}
        for batch in batches:
            out = []
            for key, ordinal, review, units, trade, _ in batch.itertuples(index=False):
                if key != now:
                    now, family, where = key, Passes(0 if pd.isna(units) else int(units), cap), {}
                place = where.get(review, 0)
                target = family.bind(place, None if pd.isna(trade) else trade)
                if target is None:
                    out.append((key, ordinal, review, None, "no pass left"))
                    continue
                outcome = "after its unit" if target == place else "carried" if family.units[target] > 1 else "new letter"
                where[review] = target
                out.append((key, ordinal, review, key + LETTERS[target - 1] if target else key, outcome))
            yield pd.DataFrame(out, columns=["pass", "ordinal", "review", "bound_pass", "outcome"])

    bound = ordered.mapInPandas(run, "pass string, ordinal long, review string, bound_pass string, outcome string")
    w = Window.partitionBy("pass", "review").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    high = asked.groupBy("pass", "review").agg(F.max("number_from").alias("high"))
    number = F.when(F.col("bound_pass").isNotNull(), F.coalesce("high", F.lit(0)) + F.count("bound_pass").over(w))
    out = bound.join(high, ["pass", "review"]).withColumn("number", number)
    return out.select("pass", "ordinal", "review", "number", F.when(F.col("number").isNotNull(), F.concat("review", F.lit("c-"), "number")).alias("continuation"), "bound_pass", "outcome")
