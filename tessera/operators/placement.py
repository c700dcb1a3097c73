"""trades' files placed with packages, by the nearest code to a file's home number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits(code: Column) -> Column:
    """A code's digits, those after its dot last."""
    return F.regexp_replace(code, r"[ .]", "")


def trimmed(code: Column) -> Column:
    """The digits without trailing pairs of 00, never below the division's two."""
    return F.regexp_replace(digits(code), r"^(..)((?:..)*?)(?:00)+$", "$1$2")


def held_by(code: Column) -> Column:
    """What a code holds: its trimmed digits, and of a group's code the last 0 dropped (`09 60 00` holds 096)."""
    t = trimmed(code)
    return F.when((F.length(t) >= 4) & F.endswith(t, F.lit("0")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def holds(code: Column, number: Column) -> Column:
    return F.startswith(digits(number), held_by(code)) | F.startswith(digits(code), digits(number))


def nearness(code: Column, home: Column) -> Column:
    """How near a code is to a home number: 0 the number itself, then broader codes, then narrower; null where it is neither, or a bare division."""
    t, number = trimmed(code), digits(home)
    broader = F.when(F.startswith(number, held_by(code)), F.length(number) - F.length(held_by(code)) + 1)
    narrower = F.when(F.startswith(digits(code), number), F.length(t) - F.length(number) + 100)
    return F.when(t == number, 0).when(F.length(t) > 2, F.coalesce(broader, narrower))


def place(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file, package, step) of every one of `files` (file, homes, numbers, otherwise), among `packages` (trade_code, codes).

    The first step that finds one counts. `home`: the least of (place of the home, 0 if the code is the package's own trade code else 1,
    nearness, trade code) over all homes and codes. `division`: a code that is the home's whole division, by the same keys. `else`: the package of the
    file that `otherwise` names, which has none of its own. `numbers`: the package that holds most of the file's numbers, the lowest of
    equal ones. Otherwise both are null. A code and a number of different divisions have nothing to do with each other, so they meet by
    their first two digits. Null and repeated codes count for nothing, or once; a package without a trade code takes no part.
    """
    division = lambda c: F.substring(digits(c), 1, 2)
    p = packages.where("trade_code is not null").select("trade_code", F.explode("codes").alias("code")).where("code is not null").distinct().withColumn("d", division(F.col("code")))
    own = F.when(F.col("code") == F.col("trade_code"), 0).otherwise(1)
    # codes meet each home and each set of numbers once, however many files have it
    at = files.select("file", F.posexplode("homes").alias("at", "home")).where("home is not null")
    met = at.select("home").distinct().withColumn("d", division(F.col("home"))).join(p, "d").withColumn("near", nearness(F.col("code"), F.col("home")))
    whole = F.concat("d", F.lit(" 00 00")) == F.col("code")
    nearest = met.groupBy("home").agg(
        F.min(F.when(F.col("near").isNotNull(), F.struct(own.alias("o"), "near", "trade_code")))["trade_code"].alias("a"), F.min(F.when(whole, F.struct(own.alias("o"), "trade_code")))["trade_code"].alias("b"),
    )
    best = at.join(nearest, "home").groupBy("file").agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c].alias(c) for c in ("a", "b")])
    has = files.select("file", F.explode("numbers").alias("number")).where("number is not null").groupBy("file").agg(F.sort_array(F.collect_set("number")).alias("set"))
    sets = has.select("set").distinct()
    numbers = sets.select("set", F.explode("set").alias("number")).withColumn("d", division(F.col("number")))
    held = numbers.select("number", "d").distinct().join(p, "d").where(holds(F.col("code"), F.col("number"))).select("number", "trade_code").distinct()
    counts = numbers.join(held, "number").groupBy("set", "trade_code").agg(F.count("*").alias("n"))
    most = counts.groupBy("set").agg(F.min(F.struct((-F.col("n")).alias("n"), "trade_code"))["trade_code"].alias("most"))
    j = files.select("file", "otherwise").join(best, "file", "left").join(has.join(most, "set").drop("set"), "file", "left")
    first = F.coalesce("a", "b")
    # a file that is named by another has no other itself: its own steps are all there are
    named = j.where("otherwise is null").select(F.col("file").alias("otherwise"), F.coalesce(first, "most").alias("c"))
    j = j.join(named, "otherwise", "left")
    step = F.when(F.col("a").isNotNull(), "home").when(F.col("b").isNotNull(), "division").when(F.col("c").isNotNull(), "else").when(F.col("most").isNotNull(), "numbers")
    return j.select("file", F.coalesce("a", "b", "c", "most").alias("package"), step.alias("step"))
