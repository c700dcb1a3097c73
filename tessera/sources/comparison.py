"""The pages of a comparison of deliveries, held to one delivery, one rule version, and the totals that they state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.grid import kind_of
from tessera.sources.shared import held, worked_out

LISTS = ("referenceRows", "manualRows")


def scan_comparison(pages: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, refusals) of `pages` (folder, file, json), several comparisons at once, each a folder; `runs`: (folder, delivery_id, rule_version).

    A page is a JSON object with `delivery.id`, `ruleVersion`, `complete`, and two lists `referenceRows` and `manualRows`, each
    (total, offset, rows), that are paged by one offset in the order of the files' names; a page without `manualRows` has none of
    them. Rules, each refused under its own name: the page is JSON and of the folder's delivery and rule version; complete; has
    its lists; a list starts where the pages before it end, unless it is empty and at or past the list's end; its total is the same on
    all pages; a row is a scope item's, with a subject and an open flag, `itemOnCurrentPage` only as a boolean, and a section on
    a manual row; no two rows are of one identity (subject, entry ids in any order, sheet, old page, box and section); a folder's
    lists hold as many rows as their totals.

    rows: (folder, file, list, ord, subject, identity, open, on_current_page, section, sheet), of every folder, so take those
    without a refusal; ord: place in its list. refusals: (folder, file, rule), once each, file null for a whole folder. A folder that
    `runs` doesn't name, or without pages, is refused. Null folders are passed over; other columns are ignored.
    """
    said = runs.where("folder is not null").select("folder", F.col("delivery_id").alias("_d"), F.col("rule_version").cast("string").alias("_v"), F.lit(True).alias("_run"))
    v = F.col("v")
    read = worked_out(pages.where("folder is not null").select("folder", "file", "json"), v=F.try_parse_json("json")).drop("json").join(said, "folder", "left")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    first = (
        F.when(F.col("_run").isNull(), "no run names its delivery")
        .when(~is_object, "not a page")
        .when(~F.try_variant_get(v, "$.delivery.id", "string").eqNullSafe(F.col("_d")), "another delivery")
        .when(~F.try_variant_get(v, "$.ruleVersion", "string").eqNullSafe(F.col("_v")), "another rule version")
        .when(~(kind_of(v, "$.complete").eqNullSafe("BOOLEAN") & F.try_variant_get(v, "$.complete", "boolean").eqNullSafe(True)), "not complete")
        .when(~F.coalesce(F.startswith(kind_of(v, "$.referenceRows"), F.lit("OBJECT")), F.lit(False)), "no referenceRows list")
    )
    read = worked_out(read, rule=first)

    def listed(name: str):
        got = F.try_variant_get(v, f"$.{name}", "variant")
        absent = got.isNull() | F.is_variant_null(got)
        field = lambda f, t: F.try_variant_get(got, f"$.{f}", t)
        rows = F.when(F.startswith(kind_of(got, "$.rows"), F.lit("ARRAY")), field("rows", "array<variant>"))
        if name == "manualRows":
            rows = F.when(absent, F.array().cast("array<variant>")).otherwise(rows)
        total = F.when(absent, 0).otherwise(field("total", "bigint")) if name == "manualRows" else field("total", "bigint")
        offset = F.when(absent, F.try_variant_get(v, "$.referenceRows.offset", "bigint")).otherwise(field("offset", "bigint")) if name == "manualRows" else field("offset", "bigint")
        return F.struct(F.lit(name).alias("list"), total.alias("total"), offset.alias("offset"), rows.alias("rows"))

    listed_ = F.array(*[listed(n) for n in LISTS])
    lists = read.where("rule is null").select("folder", "file", F.explode(listed_).alias("l")).select("folder", "file", "l.*")
    n = F.when(F.col("rows").isNotNull(), F.size("rows")).otherwise(0)
    before = Window.partitionBy("folder", "list").orderBy("file")
    so_far = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what pages state, without their rows, is written: pages are read once for all of these rules
    facts = read.select("folder", "file", "rule", F.explode_outer(F.when(F.col("rule").isNull(), listed_)).alias("l")).select("folder", "file", "rule", "l.*")
    facts = held(facts.select("folder", "file", "rule", "list", "total", "offset", n.alias("n"), F.col("rows").isNotNull().alias("is_list")))
    bad_pages = facts.where("rule is not null").select("folder", "file", "rule")
    stated = F.first("total", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    told = facts.where("rule is null").withColumn("held", so_far).withColumn("stated", stated)
    past = F.coalesce((F.col("offset") >= F.col("stated")) & (F.col("n") == 0), F.lit(False))
    starts = past | F.col("offset").eqNullSafe(F.col("held"))
    rule = F.when(~F.col("is_list"), F.concat(F.lit("no "), F.col("list"), F.lit(" list"))).when(~F.col("total").eqNullSafe(F.col("stated")), "its total changes").when(~starts, "starts elsewhere")
    told = told.withColumn("rule", rule)
    bad_lists = told.where("rule is not null").select("folder", "file", "rule")
    ends = told.groupBy("folder", "list").agg(F.sum("n").alias("n"), F.coalesce(F.max("stated"), F.lit(0)).alias("total")).where("n <> total").select("folder", F.lit(None).cast("string").alias("file"), F.lit("rows are missing").alias("rule")).distinct()

    x = F.col("x")
    text = lambda p: F.when(kind_of(x, p) == "STRING", F.try_variant_get(x, p, "string"))
    ids = F.array_sort(F.coalesce(F.try_variant_get(x, "$.entryIds", "array<string>"), F.array().cast("array<string>")))
    part = lambda p: F.to_json(F.try_variant_get(x, p, "variant"))
    # keys of a variant are in one order, whatever the order they came in
    identity = F.sha2(F.to_json(F.struct(text("$.subject").alias("subject"), ids.alias("ids"), part("$.sheetNumber").alias("sheet"), part("$.old").alias("old"), part("$.box").alias("box"), F.nullif(text("$.section"), F.lit("")).alias("section"))), 256)
    on_page = kind_of(x, "$.itemOnCurrentPage")
    flaw = (
        F.when(~text("$.kind").eqNullSafe("scopeItem"), "a row is no scope item's")
        .when(~kind_of(x, "$.open").eqNullSafe("BOOLEAN") | text("$.subject").isNull(), "a row has no open flag or no subject")
        .when(on_page.isNotNull() & (on_page != "BOOLEAN"), "itemOnCurrentPage is no flag")
        .when((F.col("list") == "manualRows") & text("$.section").isNull(), "a manual row names no section")
    )
    each = lists.where("rows is not null").select("folder", "file", "list", F.explode("rows").alias("x"))
    # one pass over the rows: a flawed one counts for its page, each other one for its identity
    each = worked_out(each, rule=flaw)
    each = each.select("folder", "file", "rule", F.when(F.col("rule").isNull(), identity).otherwise(F.col("file")).alias("key"))
    met = each.groupBy("folder", "rule", "key").agg(F.count("*").alias("n"), F.max("file").alias("file")).where("rule is not null or n > 1")
    bad_rows = met.select("folder", "file", F.coalesce("rule", F.lit("a row is there twice")).alias("rule"))

    rows = lists.withColumn("n", n).withColumn("held", so_far).where("rows is not null").select("folder", "file", "list", "held", F.posexplode("rows").alias("i", "x"))
    rows = rows.select("folder", "file", "list", (F.col("held") + F.col("i")).alias("ord"), text("$.subject").alias("subject"), identity.alias("identity"), F.try_variant_get(x, "$.open", "boolean").alias("open"), F.try_variant_get(x, "$.itemOnCurrentPage", "boolean").alias("on_current_page"), text("$.section").alias("section"), F.try_variant_get(x, "$.sheetNumber", "string").alias("sheet"))
    none = said.join(pages.select("folder").distinct(), "folder", "left_anti").select("folder", F.lit(None).cast("string").alias("file"), F.lit("no page").alias("rule"))
    refusals = bad_pages.union(bad_lists).union(ends).union(bad_rows).union(none).distinct()
    return rows, refusals
