"""Selection, counting, partition checks and reconciliation of units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import glob
from tessera.operators.ordinals import numbered, running


def select_units(df: DataFrame, discipline: Column | None = None, types: tuple[Column, list[str]] | None = None, patterns: tuple[Column, list[str]] | None = None) -> DataFrame:
    """Rows that meet every condition given; of glob patterns any."""
    tests = [] if discipline is None else [discipline]
    if types:
        tests.append(types[0].isin(types[1]))
    if patterns:
        tests.append(reduce(lambda a, b: a | b, [patterns[0].rlike(glob(p)) for p in patterns[1]]))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A5: the first row of each key, by a partial aggregate over whole rows."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def ordered_counts(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """A1: rows of each group, with the place of its first row to order by."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def cross_tab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A2: counts with zeros, in one pass."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def violations(df: DataFrame, rules: dict[str, Column], key: Column) -> DataFrame:
    """(rule, offenders, the first five keys) of each rule that a row breaks, all rules in one scan."""
    broken = df.select(key.alias("key"), F.explode(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()])).alias("rule")).where("rule is not null")
    n = broken.groupBy("rule").agg(F.count("*").alias("offenders"))
    w = Window.partitionBy("rule").orderBy("key")
    five = broken.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("key")), ", ").alias("named"))
    return n.join(five, "rule")


def require(df: DataFrame, rules: dict[str, Column], key: Column) -> DataFrame:
    """P11 as a gate: refuses with the rule, its first offenders and their number; nothing passes then."""
    bad = violations(df, rules, key).orderBy("rule").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['rule']}: {bad[0]['named']} ({bad[0]['offenders']} in all)")
    return df


def reconcile(plan: DataFrame, found: DataFrame, key: list[str], planned: str, counted: str) -> DataFrame:
    """Full outer comparison: missing, extra, below, above, same."""
    j = plan.select(*key, F.col(planned).alias("planned")).join(found.select(*key, F.col(counted).alias("counted")), key, "full_outer")
    verdict = F.when(F.col("counted").isNull(), "missing").when(F.col("planned").isNull(), "extra").when(F.col("counted") < F.col("planned"), "below").when(F.col("counted") > F.col("planned"), "above").otherwise("same")
    return j.withColumn("verdict", verdict)


def partition_check(whole: DataFrame, parts: list[DataFrame], key: list[str]) -> DataFrame:
    """U4: keys that are not in exactly one part, or in a part but not in the whole; empty if the parts are exact."""
    tagged = reduce(DataFrame.unionByName, [p.select(*key, F.lit(0).alias("_w"), F.lit(1).alias("_p")) for p in parts], whole.select(*key, F.lit(1).alias("_w"), F.lit(0).alias("_p")))
    return tagged.groupBy(*key).agg(F.sum("_w").alias("in_whole"), F.sum("_p").alias("in_parts")).where("in_whole <> 1 or in_parts <> 1")


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Each identity as new, gone, same or changed, by a digest of its content."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    b = before.select(*key, digest.alias("_b"))
    a = after.select(*key, digest.alias("_a"))
    verdict = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return b.join(a, key, "full_outer").select(*key, verdict.alias("verdict"))


def current_values(entries: DataFrame, slot: list[str], entry: str, supersedes: str, at: str) -> DataFrame:
    """R2: the value that stands in each slot: not superseded within it, newest, lowest id on a tie."""
    old = entries.where(F.col(supersedes).isNotNull()).select(*slot, F.col(supersedes).alias(entry)).distinct()
    live = entries.join(old, [*slot, entry], "left_anti")
    row = F.struct(*[F.col(c) for c in entries.columns])
    return live.groupBy(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(slot)]).agg(F.max_by(row, F.struct(F.col(at), -F.col(entry))).alias("_r")).select("_r.*")


def running_cap(df: DataFrame, key: list[str], order: list[str], line: str, cap: int) -> DataFrame:
    """The lines that fit whole under a cap on characters, a line break counted for each; a null line is passed over."""
    return running(df.where(F.col(line).isNotNull()), order, F.length(line) + 1, key, "used").where(F.col("used") <= cap)


def capped_print(df: DataFrame, key: list[str], order: list[str], line: str, cap: int, from_line: int = 1, from_char: int = 0) -> DataFrame:
    """K6: (key, printed, next_line, next_char) of one call of a resumable print, from a cursor on: whole lines while they fit in `cap`.

    A line that does not fit by itself is cut, at the first place of a call only, so that every call gets on; the cursor then stands
    within it. next_line and next_char are null where all is printed. Lines are numbered from 1 in each key's order; null lines are empty.
    """
    n = numbered(df.withColumn("_text", F.coalesce(line, F.lit(""))), order, key, "_n").where(F.col("_n") >= from_line)
    n = n.withColumn("_text", F.when(F.col("_n") == from_line, F.substring("_text", F.lit(from_char + 1), F.length("_text"))).otherwise(F.col("_text")))
    used = running(n.select(*key, "_n", "_text"), ["_n"], F.length("_text") + 1, key, "_used")
    shown = used.where((F.col("_used") <= cap) | (F.col("_n") == from_line))
    cut = (F.col("_n") == from_line) & (F.col("_used") > cap)
    text = F.when(cut, F.substring("_text", 1, cap)).otherwise(F.col("_text"))
    # what is printed has at most `cap` characters, whatever the key holds
    got = shown.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))), lambda x: x["t"]), "\n").alias("printed"), F.max("_n").alias("_last"), F.bool_or(cut).alias("_cut"))
    last = used.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max("_n").alias("_all"))
    out = got.join(last, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    more = F.col("_cut") | (F.col("_last") < F.col("_all"))
    at = F.when(F.col("_cut"), F.col("_last")).otherwise(F.col("_last") + 1)
    return out.select(*key, "printed", F.when(more, at).alias("next_line"), F.when(more, F.when(F.col("_cut"), from_char + cap).otherwise(0)).alias("next_char"))


def fill_down(df: DataFrame, key: list[str], order: list[str], heading: Column) -> DataFrame:
    """The last heading at or above each row."""
    return df.withColumn("block", F.last(heading, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order)))


def dropped_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A5: the rows that `keep_first` leaves out, each with `kept`, the order of the one that stands for it. Nulls of a key are a key."""
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(F.struct(*order)).alias("kept"))
    return df.join(first, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]).where(F.struct(*order) > F.col("kept")).select(*[df[c] for c in df.columns], "kept")


def include_exclude(df: DataFrame, column: Column, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows of any glob of `include` (none: all rows) and none of `exclude`, which wins; a null matches nothing."""
    any_of = lambda globs: reduce(lambda a, b: a | b, [F.coalesce(column.rlike(glob(g)), F.lit(False)) for g in globs], F.lit(False))
    return df.where((any_of(include) if include else F.lit(True)) & ~any_of(exclude))


def pattern_matches(df: DataFrame, column: Column, patterns: list[str]) -> DataFrame:
    """(pattern, n): how many rows each glob matches, in one pass; one that matches nothing is to be refused."""
    counts = df.agg(*[F.count_if(F.coalesce(column.rlike(glob(p)), F.lit(False))).alias(f"_{i}") for i, p in enumerate(patterns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"_{i}").alias("n")) for i, p in enumerate(patterns)])).alias("x")).select("x.*")
