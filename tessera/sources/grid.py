"""The further pages of a sheet number, from the nested list that each row of a grid carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind_of(v: Column, path: str) -> Column:
    """Type of a field of a variant: `VOID` for a JSON null, null where the field is absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def shown(v: Column, path: str) -> Column:
    """A field as text, an absent one or null as empty."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def further_pages(rows: DataFrame, read_from: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(further, carried, refusals) of grid rows (row_ord, number, discipline, file_id, page, raw), raw a VARIANT.

    `raw` has `pageOccurrences`, a list of the pages that the row's number prints on: empty where it prints on one only. Of a
    longer list exactly one entry is `selected`, and that is the row's own file and page. Each other one must have a `deliveryId`,
    which keeps three cases apart: null is the row's own delivery, an id of `read_from` one that the run reads from, and both
    give a row of their own in `further` (row_ord, pos, number, discipline, file_id, page, title, sheet_type, opens_as, unit_key),
    placed by row_ord and pos right after the row; any other id only names the page, in `carried` (row_ord, pos, number, file_id,
    page, delivery_id). An absent `deliveryId`, or one that is no text, is refused, as are an entry that is to be read but lacks a
    file, a page number from 1 or the key it opens as; a page listed twice; and a page that is some row's own or an earlier row's further page.

    `refusals` (row_ord, pos, rule) has every entry that breaks a rule, pos null where the list as a whole does; a refused entry, and
    every entry of a list that is refused, gives no row. Null numbers read as empty; other columns are ignored.
    """
    raw = F.col("raw")
    occ = F.try_variant_get(raw, "$.pageOccurrences", "array<variant>")
    own = lambda x: kind_of(x, "$.selected").eqNullSafe("BOOLEAN") & F.try_variant_get(x, "$.selected", "boolean").eqNullSafe(True)
    base = rows.select("row_ord", F.coalesce("number", F.lit("")).alias("number"), "discipline", F.coalesce("file_id", F.lit("")).alias("file_id"), F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page"), occ.alias("occ"), F.coalesce(F.startswith(kind_of(raw, "$.pageOccurrences"), F.lit("ARRAY")), F.lit(False)).alias("is_list"))
    base = base.withColumn("is_list", F.col("is_list") & ~F.exists("occ", lambda x: ~F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False))))
    base = base.withColumn("mine", F.filter("occ", own))
    mine = F.get("mine", F.lit(0))
    whole = (
        F.when(~F.col("is_list"), "no pageOccurrences list")
        .when((F.size("occ") > 0) & (F.size("mine") != 1), "not one page is its own")
        .when((F.size("occ") > 0) & ((shown(mine, "$.fileId") != F.col("file_id")) | (shown(mine, "$.pageInPdf") != F.col("page"))), "its own page is another")
    )
    base = base.withColumn("whole", whole)

    each = base.where("whole is null").select("row_ord", "number", "discipline", "file_id", "page", F.posexplode("occ").alias("pos", "x"))
    x = F.col("x")
    kind, delivery = kind_of(x, "$.deliveryId"), F.try_variant_get(x, "$.deliveryId", "string")
    is_id = (kind == "STRING") & (F.trim(delivery) != "")
    given = F.when(kind.isNull(), "no deliveryId").when(~((kind == "VOID") | is_id), "deliveryId is neither null nor an id")
    read = (kind == "VOID") | (is_id & delivery.isin(read_from))
    text = lambda p: F.coalesce((kind_of(x, p) == "STRING") & (F.try_variant_get(x, p, "string") != ""), F.lit(False))
    number = F.coalesce((kind_of(x, "$.pageInPdf") == "BIGINT") & (F.try_variant_get(x, "$.pageInPdf", "bigint") > 0), F.lit(False))
    lacks = F.concat_ws(" and ", F.when(~text("$.fileId"), "no file"), F.when(~text("$.opensAs"), "no key it opens as"), F.when(~number, "no page number"))
    each = each.select(
        "row_ord", "pos", "number", "discipline", F.col("file_id").alias("own_file"), F.col("page").alias("own_page"), shown(x, "$.fileId").alias("file_id"), shown(x, "$.pageInPdf").alias("page"), own(x).alias("own"),
        F.coalesce(read, F.lit(False)).alias("read"), delivery.alias("delivery_id"), given.alias("given"), lacks.alias("lacks"), F.try_variant_get(x, "$.title", "string").alias("title"),
        F.try_variant_get(x, "$.sheetType", "string").alias("sheet_type"), F.try_variant_get(x, "$.opensAs", "string").alias("opens_as"),
    )
    again = F.row_number().over(Window.partitionBy("row_ord", "file_id", "page").orderBy(F.col("own").desc(), "pos")) > 1
    each = each.withColumn("again", again).where("not own")
    rule = F.when(F.col("given").isNotNull(), F.col("given")).when(F.col("read") & (F.col("lacks") != ""), F.col("lacks")).when(F.col("again"), "listed twice")
    each = each.withColumn("rule", rule)

    # a page has one owner: the row it is the own page of, else the first row that lists it as a further one
    taken = base.select("file_id", "page").distinct().withColumn("owned", F.lit(True))
    placed = each.where("rule is null and read").join(taken, ["file_id", "page"], "left")
    first = Window.partitionBy("file_id", "page").orderBy("row_ord", "pos")
    placed = placed.withColumn("rule", F.when(F.col("owned").isNotNull() | (F.row_number().over(first) > 1), "already another row's page"))
    key = F.concat(F.col("number"), F.lit("@"), F.col("file_id"), F.lit("#"), F.col("page"))
    further = placed.where("rule is null").select("row_ord", "pos", "number", "discipline", "file_id", "page", "title", "sheet_type", "opens_as", key.alias("unit_key"))
    carried = each.where("rule is null and not read").select("row_ord", "pos", F.when(F.col("number") == "", "(no sheet number)").otherwise(F.col("number")).alias("number"), "file_id", "page", "delivery_id")
    pick = ["row_ord", "pos", "rule"]
    refusals = base.where("whole is not null").select("row_ord", F.lit(None).cast("int").alias("pos"), F.col("whole").alias("rule")).union(each.where("rule is not null").select(pick)).union(placed.where("rule is not null").select(pick))
    return further, carried, refusals
