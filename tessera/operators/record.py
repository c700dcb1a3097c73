"""Rules of the record: appends, searches, reconciliation of three sources, names of companies, components of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of one batch at most.
BATCH = 500


def append(current: DataFrame, entries: DataFrame, slot: list[str], entry: str = "entry_id", supersedes: str = "supersedes_id") -> DataFrame:
    """`entries` with `accepted` and `standing`: a free field takes one, an occupied one only what names the entry that stands."""
    head = current.select(*slot, F.col(entry).alias("standing"))
    out = entries.join(head, slot, "left")
    return out.withColumn("accepted", F.col("standing").isNull() | F.coalesce(F.col(supersedes) == F.col("standing"), F.lit(False)))


def batch_verdict(entries: DataFrame, batch: str, place: str, valid: Column) -> DataFrame:
    """(batch, entries, first_bad, accepted): a batch is written whole or not at all; the first bad place is named."""
    g = entries.groupBy(batch).agg(F.count("*").alias("entries"), F.min(F.when(~F.coalesce(valid, F.lit(False)), F.col(place))).alias("first_bad"))
    return g.withColumn("accepted", F.col("first_bad").isNull() & (F.col("entries") <= BATCH))


def search(entries: DataFrame, *, subject: str | None = None, prefix: str | None = None, predicate: str | None = None, text: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Entries that meet every condition given, in the order of their ids, a page of them."""
    out = entries
    for given, test in ((subject, F.col("subject") == subject), (prefix, F.col("subject").startswith(prefix or "")), (predicate, F.col("predicate") == predicate)):
        if given is not None:
            out = out.where(test)
    if text is not None:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "subject", "predicate", "value")), F.lit(text.lower())))
    return out.orderBy("entry_id").offset(offset).limit(limit)


def reconcile_three(declared: DataFrame, present: DataFrame, spec: DataFrame | None, key: str) -> DataFrame:
    """(key, verdict, in_spec): matched, index-only or set-only; in_spec is null where no specification was read, which is not false."""
    d, p = declared.select(key, F.lit(True).alias("_d")).distinct(), present.select(key, F.lit(True).alias("_p")).distinct()
    out = d.join(p, key, "full_outer")
    said = F.lit(None).cast("boolean")
    if spec is not None:
        out = out.join(spec.select(key, F.lit(True).alias("_s")).distinct(), key, "left")
        said = F.coalesce("_s", F.lit(False))
    return out.select(key, F.when(F.col("_p").isNull(), "index-only").when(F.col("_d").isNull(), "set-only").otherwise("matched").alias("verdict"), said.alias("in_spec"))


def verify_unit(entries: DataFrame, claims: DataFrame, unit: Column) -> DataFrame:
    """(unit, entries, subjects, claimed, holds): what a unit wrote against what it says it did."""
    n = entries.groupBy(unit.alias("unit")).agg(F.count("*").alias("entries"), F.countDistinct("subject").alias("subjects"))
    out = n.join(claims.select("unit", "claimed"), "unit", "full_outer").select("unit", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("subjects", F.lit(0)).alias("subjects"), "claimed")
    return out.withColumn("holds", F.coalesce(F.col("claimed") == F.col("subjects"), F.lit(False)))


def company_key(name: Column) -> Column:
    """A company's name without capitals, punctuation, spacing and its ending."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^0-9a-z]+", " "))
    return F.regexp_replace(F.regexp_replace(plain, r"\s(inc|llc|ltd|co|corp|company|incorporated|limited|corporation)$", ""), " ", "")


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with the one right row of their key; where the key has several, none matches."""
    one = right.groupBy(key).agg(F.count("*").alias("_n"), F.min_by(F.struct(*[c for c in right.columns if c != key]), F.struct(*[c for c in right.columns if c != key])).alias("_r")).where("_n = 1")
    return left.join(one.select(key, "_r.*"), key, "left")


def name_links(holders: DataFrame, name: str, item: str) -> DataFrame:
    """(name, from, to): one link for each further holder of a name, from its smallest: a spanning tree, not all pairs."""
    first = holders.groupBy(name).agg(F.min(item).alias("from"))
    return holders.join(first, name).where(F.col(item) != F.col("from")).select(name, "from", F.col(item).alias("to")).distinct()


def next_slots(passes: DataFrame, order: list[str], ready: Column, running: Column, slots: int = 6) -> DataFrame:
    """The next passes to start: ready ones in plan order, as many as running ones leave of the slots. A plan is small."""
    busy = passes.agg(F.count_if(running).alias("_busy"))
    first = passes.where(ready).orderBy(*order).limit(slots)
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return first.withColumn("_n", n).join(F.broadcast(busy)).where(F.col("_n") <= slots - F.col("_busy")).drop("_n", "_busy")


def check_in_due(log: DataFrame, key: list[str], order: list[str], marker: Column, counted: Column, every: int = 4) -> DataFrame:
    """(key, since, due): counted lines after the last marker; a check-in is due at `every`. One aggregate and a join, no sort."""
    at = F.struct(*order)
    last = log.where(marker).groupBy(*key).agg(F.max(at).alias("_last"))
    g = log.join(last, key, "left").groupBy(*key).agg(F.count_if(counted & (F.col("_last").isNull() | (at > F.col("_last")))).alias("since"))
    return g.withColumn("due", F.col("since") >= every)


def live_locations(entries: DataFrame) -> DataFrame:
    """(subject, state, entry_id, value) of every subject of `entries` (entry_id, subject, predicate, supersedes_id, asserted_at, value, names).

    A `locatedAt` entry is live unless an entry of its own subject and predicate supersedes it, or a standing retraction names it: a
    `retractedBy` entry whose `names` (a list of ids) has its id stands unless a `retractionReversal` entry names it in turn. The
    newest live one counts, of equal times the lowest id. Three states are kept apart: `never located`, `removed` (located once,
    none is live) and `located`, which alone has an entry_id and value. What supersedes across subjects has no effect; ids in
    `names` that no entry has name nothing; null subjects are passed over, a null time is the oldest.
    """
    e = entries.where("subject is not null")
    named = lambda p: e.where(F.col("predicate") == p).select(F.col("entry_id").alias("by"), F.explode("names").alias("entry_id"))
    undone = named("retractionReversal").select(F.col("entry_id").alias("by")).distinct()
    gone = named("retractedBy").join(undone, "by", "left_anti").select("entry_id").distinct()
    places = e.where("predicate = 'locatedAt'").select("entry_id", "subject", "supersedes_id", "asserted_at", "value")
    old = places.where("supersedes_id is not null").select("subject", F.col("supersedes_id").alias("entry_id")).distinct()
    live = places.join(old, ["subject", "entry_id"], "left_anti").join(gone, "entry_id", "left_anti")
    # of the newest time the lowest id: ids are numbers or texts, so the order is told in two steps
    newest = live.groupBy("subject").agg(F.max("asserted_at").alias("_t"))
    best = live.join(newest, "subject").where(F.col("asserted_at").eqNullSafe(F.col("_t"))).groupBy("subject").agg(F.min(F.struct("entry_id", "value")).alias("_b"))
    ever = e.groupBy("subject").agg(F.bool_or(F.col("predicate") == "locatedAt").alias("_ever"))
    state = F.when(F.col("_b").isNotNull(), "located").when(F.col("_ever"), "removed").otherwise("never located")
    return ever.join(best, "subject", "left").select("subject", state.alias("state"), F.col("_b.entry_id").alias("entry_id"), F.col("_b.value").alias("value"))


def revision(heads: DataFrame, named: DataFrame, modes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writes, refusals) of revised proposals: `heads` (party, package, line, entry_id, value) are what stands, `named` (party, package, line, value) what
    a revision says, `modes` (party, package, mode) how it is meant.

    writes: (party, package, line, value, cleared, supersedes_id). A line that the revision names is written, in place of what stands there; a `wholesale` one
    also clears every line of the party and package that stands and is not named, and a `surgical` one leaves them. What is written
    as it stands is no write. refusals: (party, package, rule): a revision without a mode, or another; two modes; a line named twice with
    different values. A refused revision writes nothing. A value cleared before (null) is not cleared again.
    """
    key = ["party", "package"]
    m = modes.groupBy(*key).agg(F.collect_set("mode").alias("m"))
    said = named.groupBy(*key, "line").agg(F.max("value").alias("value"), F.countDistinct(F.coalesce(F.col("value"), F.lit("")), F.col("value").isNull()).alias("n"))
    two = said.where("n > 1").select(*key).distinct().withColumn("_twice", F.lit(True))
    all_ = said.select(*key).distinct().join(m, key, "full_outer").join(two, key, "left")
    rule = F.when(F.col("m").isNull() | (F.size("m") == 0), "no mode").when(F.size("m") > 1, "two modes").when(~F.get("m", F.lit(0)).isin("wholesale", "surgical"), "another mode").when(F.col("_twice"), "a line is named twice")
    all_ = all_.withColumn("rule", rule)
    good = all_.where("rule is null").select(*key, F.get("m", F.lit(0)).alias("mode"))
    stand = heads.select(*key, "line", F.col("entry_id").alias("supersedes_id"), F.col("value").alias("before"), F.lit(True).alias("stands")).join(good, key)
    new = said.select(*key, "line", "value", F.lit(True).alias("named")).join(good.select(*key), key)
    j = new.join(stand, [*key, "line"], "full_outer")
    change = F.col("named") & ~(F.col("stands").isNotNull() & F.col("value").eqNullSafe(F.col("before")))
    clear = F.col("named").isNull() & (F.col("mode") == "wholesale") & F.col("before").isNotNull()
    j = j.withColumn("cleared", clear).where(F.coalesce(change, F.lit(False)) | clear)
    return j.select(*key, "line", F.when(~F.col("cleared"), F.col("value")).alias("value"), "cleared", "supersedes_id"), all_.where("rule is not null").select(*key, "rule")


def bid_totals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, refusals) of bidders' rows (party, row, additional, amount, direction, alternate, accepted).

    totals: (party, base, accepted_alternates, total): an alternate, `direction` add or deduct and a magnitude, moves nothing until it is accepted, and
    never the base. base is null where a party has no amount, which is not a base of 0. refusals: (party, row, rule): a negative magnitude, a magnitude without
    a direction or the other way round, another direction, and an additional item that has both an amount and an alternate. Refused rows count for nothing.
    """
    c = F.col
    rule = (
        F.when(c("alternate") < 0, "a negative magnitude").when(c("alternate").isNull() & c("direction").isNotNull(), "no magnitude").when(c("alternate").isNotNull() & c("direction").isNull(), "no direction")
        .when(~c("direction").isin("add", "deduct"), "another direction").when(F.coalesce(c("additional"), F.lit(False)) & c("amount").isNotNull() & c("alternate").isNotNull(), "an additional item with an amount and an alternate")
    )
    r = rows.withColumn("rule", rule)
    taken = F.when(F.coalesce(c("accepted"), F.lit(False)), F.when(c("direction") == "deduct", -c("alternate")).otherwise(c("alternate")))
    t = r.where("rule is null").groupBy("party").agg(F.sum("amount").alias("base"), F.coalesce(F.sum(taken), F.lit(0)).alias("accepted_alternates"))
    return t.withColumn("total", c("base") + c("accepted_alternates")), r.where("rule is not null").select("party", "row", "rule")


def ambiguous_matches(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """(key, n, one, other) of the keys of `left` that several rows of `right` have, with the two smallest of their names; none may pass."""
    g = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(name)), 1, 2).alias("_two")).where("n > 1")
    return g.join(left.select(key).distinct(), key, "left_semi").select(key, "n", F.get("_two", F.lit(0)).alias("one"), F.get("_two", F.lit(1)).alias("other"))


def standing(entries: DataFrame, item: str, order: list[str], retires: Column, restores: Column) -> DataFrame:
    """(item, state): `standing`, `retired` or `restored`, by the last entry that retires or restores it; a restore without a retirement before it changes nothing."""
    kind = F.when(retires, "retired").when(restores, "restored")
    e = entries.where(F.col(item).isNotNull()).select(F.col(item), F.struct(*order).alias("_o"), kind.alias("_kind"))
    g = e.groupBy(item).agg(F.max_by("_kind", F.when(F.col("_kind").isNotNull(), F.col("_o"))).alias("_last"), F.min(F.when(F.col("_kind") == "retired", F.col("_o"))).alias("_first"))
    return g.select(item, F.when(F.col("_first").isNull(), "standing").otherwise(F.col("_last")).alias("state"))
