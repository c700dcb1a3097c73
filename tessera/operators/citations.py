"""The citation index: every definition code and item tag matched to every page that prints it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import numbered
from tessera.sources.shared import BROADCAST_ROWS, dealt, held, looked_up

# The kinds of what an index leaves open.
LEFTOVERS = (
    "unmatchedTag", "codeNoLocation", "codeOnlyOnReplacedPages", "codeTooShort", "codeIsAWord", "fragmentUnresolvable",
    "pageNotASheet", "hitNotDrawable", "overRunCap",
)
#: Words of a code by which it is looked up; a longer one is then compared whole.
GRAM = 4
#: Hits of a page by which they are dealt out.
HITS = 4


def words(text: Column) -> Column:
    """A text's words, lower-cased: runs of letters, digits and inner dots, dashes and slashes."""
    cut = F.split(F.lower(text), r"[^\p{L}\p{N}./-]+")
    return F.filter(F.transform(cut, lambda w: F.regexp_replace(w, r"^[./-]+|[./-]+$", "")), lambda w: w != "")


def code_key(code: Column) -> Column:
    """A code as it is compared: its words with one blank between."""
    return F.array_join(words(code), " ")


def too_short(code: Column) -> Column:
    return F.length(F.regexp_replace(code, r"\s", "")) <= 2


def is_word(code: Column) -> Column:
    """A code that prints as an ordinary word: no digit, and no hyphen between two letters or digits."""
    return ~code.rlike(r"\p{N}") & ~code.rlike(r"[\p{L}\p{N}]-[\p{L}\p{N}]")


def find_codes(pages: DataFrame, codes: DataFrame, rows: int | None = None) -> DataFrame:
    """(page, code), once each: the codes (code: as `code_key` gives it) that each of `pages` (page, text) prints as whole words in a row.

    Each page is cut into runs of as many words as some code has, which meet the codes by an equi-join; neither texts nor pages
    meet each other. Runs of words that most pages print pass by the codes, unsorted. Null texts and empty codes match nothing.
    With `rows`, about so many, what is found is dealt out by page for so many.
    """
    apart = lambda df: (df if rows is None else dealt(df, rows, "page")).distinct()
    codes = codes.select("code").where("code <> ''").distinct()
    parts = F.split("code", " ")
    codes = codes.select("code", F.array_join(F.slice(parts, 1, GRAM), " ").alias("gram"), F.size(parts).alias("length"))
    lengths = [r["n"] for r in codes.select(F.least("length", F.lit(GRAM)).alias("n")).distinct().orderBy("n").collect()]  # at most GRAM numbers
    if not lengths:
        return pages.select("page", F.lit(None).cast("string").alias("code")).where("false")
    all_short = codes.where(F.col("length") > GRAM).isEmpty()
    w = pages.where("text is not null").select("page", words(F.col("text")).alias("w"))
    runs = F.concat(*[_runs(F.col("w"), n) for n in lengths])
    grams = w.select("page", F.explode(F.array_distinct(runs)).alias("gram"))
    # of longer runs, only those that begin as some code does, if codes begin with few words
    starts = codes.where(F.size(F.split("gram", " ")) > 1).select(F.substring_index("gram", " ", 1).alias("start")).distinct()
    if starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        grams = grams.join(F.broadcast(starts), F.substring_index("gram", " ", 1) == F.col("start"), "left").where(F.col("start").isNotNull() | ~F.contains("gram", F.lit(" "))).select("page", "gram")
    met = grams.join(looked_up(codes), "gram")
    if all_short:
        return apart(met.select("page", "code"))
    # a code of more words is compared with the page's words, read once more for the few pages where it may stand
    near = met.where(F.col("length") > GRAM).select("page", "code").distinct().join(w, "page")
    whole = near.where(F.contains(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("code"), F.lit(" "))))
    return apart(met.where(F.col("length") <= GRAM).select("page", "code").union(whole.select("page", "code")))


def _runs(w: Column, n: int) -> Column:
    """Runs of n adjoining words."""
    if n == 1:
        return w
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))


def index_citations(pages: DataFrame, record: DataFrame, cited: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(citations to write (subject, page), leftovers (kind, subject, code, page)).

    `pages`: (page, text, is_sheet, replaced, drawable); `record`: (subject, kind, code), kind `definition` or `item`, whose code is
    its tag; `cited`: (subject, page). A page that prints a code is cited onto each subject that carries the code, unless it
    is already cited there. Left open, and never cited, are: codes too short, codes that print as a word (one row a subject);
    an item's tag that is the first words of a definition's code and no definition's whole code (one row a subject); a definition's
    code on no page, or only on replaced ones; an item's tag on no page; pages that are no sheets, and hits that can't be drawn (one row a hit); what lies beyond `cap` citations in the order of subject and page. A flag that is null reads as false; subjects
    without a code, pages without an id and repeated rows count for nothing; other columns are ignored; empty tables give none.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    record = record.where("subject is not null and code is not null").select("subject", "kind", F.col("code").alias("print"), code_key(F.col("code")).alias("code")).where("code <> ''").distinct()
    record = record.withColumn("aside", F.when(too_short(F.col("print")), "codeTooShort").when(is_word(F.col("print")), "codeIsAWord")).drop("print")
    # an item's tag that is the first words of a longer code can't be told from it on a page
    own = record.where("kind = 'definition' and aside is null").select("code").distinct()
    parts = F.split("code", " ")
    first = own.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), " "))).alias("code")).distinct()
    pieces = first.join(own, "code", "left_anti").withColumn("piece", F.lit("fragmentUnresolvable"))
    record = record.join(pieces, "code", "left").withColumn("aside", F.coalesce("aside", F.when(F.col("kind") == "item", F.col("piece")))).drop("piece")
    asked = record.where("aside is null").drop("aside")
    pages = pages.where("page is not null")
    rows = HITS * pages.count()
    flags = dealt(pages.select("page", *[flag(c).alias(c) for c in ("is_sheet", "drawable", "replaced")]), rows, "page")
    flags = flags.groupBy("page").agg(*[F.bool_or(c).alias(c) for c in ("is_sheet", "drawable")], F.bool_and("replaced").alias("replaced"))
    # written once, as the leftovers ask for them many times
    hits = held(find_codes(pages.select("page", "text"), asked, rows).join(flags, "page"))

    standing = hits.where(~F.col("replaced"))
    fine = dealt(standing.where("is_sheet and drawable").select("code", "page"), rows, "code").join(asked, "code").select("subject", "page")
    fine, known = (dealt(x.select("subject", "page"), rows, "subject", "page").distinct() for x in (fine, cited))
    fresh = fine.join(known, ["subject", "page"], "left_anti")
    blank = F.lit(None).cast("string")
    over = None
    if cap is not None:
        placed = numbered(fresh, ["subject", "page"])
        fresh, over = placed.where(F.col("ordinal") <= cap).drop("ordinal"), placed.where(F.col("ordinal") > cap)

    found = hits.groupBy("code").agg(F.bool_or(~F.col("replaced")).alias("stands"))
    seen = asked.join(found, "code", "left")
    none = F.lit(None).cast(pages.schema["page"].dataType).alias("page")
    lost = seen.where("kind = 'definition' and not coalesce(stands, false)").select(F.when(F.col("stands").isNull(), "codeNoLocation").otherwise("codeOnlyOnReplacedPages").alias("kind"), "subject", "code", none)
    tags = seen.where("kind = 'item' and stands is null").select(F.lit("unmatchedTag").alias("kind"), "subject", "code", none)
    aside = record.where("aside is not null").select(F.col("aside").alias("kind"), "subject", "code", none)
    bad = standing.where("not (is_sheet and drawable)").select(F.when(F.col("is_sheet"), "hitNotDrawable").otherwise("pageNotASheet").alias("kind"), blank.alias("subject"), "code", "page")
    left = lost.unionByName(tags).unionByName(aside).unionByName(bad)
    if over is not None:
        left = left.unionByName(over.select(F.lit("overRunCap").alias("kind"), "subject", blank.alias("code"), "page"))
    return fresh, left


def leftover_counts(leftovers: DataFrame) -> DataFrame:
    """(kind, n) of every kind, those without a row too."""
    kinds = leftovers.sparkSession.createDataFrame([(k,) for k in LEFTOVERS], "kind string")
    return kinds.join(leftovers.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
