"""Tables of standard lines in trades' files, the trades that a line names, and who writes each half of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import held

# The kinds of lines, the table's heading and its rule, and the limits of a row's name.
KINDS = ("Pricing", "Incidental", "Convention", "Which Trade")
HEADER, RULE = "| Kind | Line | Condition | Where to Look | Row Name |", r"^\|(-+\|){5}$"
NAME_MOST = 36
PAIRS = r"^\d\d( \d\d){0,2}$"
#: Distinct lines or conditions up to which what they say is broadcast to the rows.
BROADCAST_TEXTS = 100_000


def _items(text: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def _digits(code: Column) -> Column:
    return F.replace(code, F.lit(" "), F.lit(""))


def _said(texts: DataFrame) -> DataFrame:
    """What each distinct text says, worked out once and written; broadcast if the texts are few."""
    texts = held(texts)
    return F.broadcast(texts) if texts.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else texts


def scan_standard_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, rows, refusals) of trades' files, from their lines (file, line_no, line); many at once.

    A file has a title `# <trade>`, a line `Numbers:` and a line `Home:`, each a list of pairs of digits (`09 65`), where a home is one of the
    numbers or narrower and none is there twice; perhaps a line `Else:` with another trade; and a table under one heading, its rows of five
    cells. The first line of each kind counts. A row has one of four kinds, a line, and names that are split at `;`, 36 characters at
    most, without a comma, no two of a file the same but for capitals; a row that is no `Which Trade` has one name.

    files: (file, title, numbers, homes, otherwise); rows: (file, ord, kind, line, condition, look, names). refusals: (file, ord, rule), the first
    rule that the file (ord null) or a row breaks; a refused row is not in `rows`, the rows of a refused file are. Null lines are blank.
    """
    read = lines.where("file is not null and line_no is not null").select("file", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    line = F.col("line")
    first = lambda mark: F.min(F.when(F.startswith(line, F.lit(mark)), F.struct("line_no", F.trim(F.substring(line, len(mark) + 1, 100_000)).alias("x"))))["x"]
    is_bar = F.startswith(F.trim(line), F.lit("|"))
    placed = read.withColumn("at", (F.count_if(is_bar).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)) - 2).cast("int"))
    bar = lambda test: F.coalesce(F.bool_or(is_bar & test), F.lit(False))
    # a file's lines are dealt out and sorted once, for their places and for what it says
    g = placed.groupBy("file").agg(
        first("# ").alias("title"), first("Numbers:").alias("n"), first("Home:").alias("h"), first("Else:").alias("otherwise"),
        (bar((F.col("at") == -1) & (F.trim(line) == HEADER)) & bar((F.col("at") == 0) & F.trim(line).rlike(RULE))).alias("opens"), F.count_if(is_bar & (F.col("at") > 0)).alias("n_rows"),
    )
    g = g.withColumn("numbers", _items(F.col("n"), ",")).withColumn("homes", _items(F.col("h"), ","))
    under = F.exists("homes", lambda h: ~F.exists("numbers", lambda n: F.startswith(_digits(h), _digits(n))))
    rule = (
        F.when(F.coalesce("title", F.lit("")) == "", "no title").when(F.col("n").isNull(), "no Numbers line").when(F.size("numbers") == 0, "no number").when(F.exists("numbers", lambda n: ~n.rlike(PAIRS)), "a number is no pairs of digits")
        .when(F.col("h").isNull(), "no Home line").when(F.size("homes") == 0, "no home").when(F.exists("homes", lambda n: ~n.rlike(PAIRS)), "a home is no pairs of digits").when(under, "a home is under none of the numbers")
        .when(F.size(F.array_distinct("homes")) < F.size("homes"), "a home is there twice").when(F.col("otherwise") == "", "no trade on the Else line").when(~F.coalesce("opens", F.lit(False)), "does not open its table").when(F.col("n_rows") == 0, "no line")
    )
    g = g.withColumn("rule", rule)

    shut = F.endswith("row", F.lit("|")) & (F.length("row") > 1)
    cells = F.when(shut, F.transform(F.split(F.substring("row", F.lit(2), F.length("row") - 2), "[|]", -1), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    rows = placed.where(is_bar & (F.col("at") > 0)).select("file", F.col("at").alias("ord"), F.trim(line).alias("row")).select("file", "ord", cells.alias("c"))
    cell = lambda i: F.get("c", F.lit(i))
    names = F.when(cell(4) != "", F.transform(F.split(cell(4), ";", -1), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("file", "ord", F.size("c").alias("n"), cell(0).alias("kind"), cell(1).alias("line"), cell(2).alias("condition"), cell(3).alias("look"), names.alias("names"))
    # names are told apart among a file's rows, where these are: neither is dealt out again
    seen = rows.select("*", F.posexplode_outer(F.transform("names", lambda x: F.lower(x))).alias("i", "name")).withColumn("k", F.row_number().over(Window.partitionBy("file", "name").orderBy("ord", "i")))
    rows = seen.groupBy(*rows.columns).agg(F.max(F.col("name").isNotNull() & (F.col("k") > 1)).alias("again"))
    flaw = (
        F.when(F.col("n") != 5, "not five cells").when(~F.col("kind").isin(*KINDS), "no such kind").when(F.col("line") == "", "no line in the row").when((F.size("names") == 0) | F.exists("names", lambda x: x == ""), "no row name")
        .when(F.exists("names", lambda x: F.length(x) > NAME_MOST), "a row name is too long").when(F.exists("names", lambda x: F.contains(x, F.lit(","))), "a row name has a comma").when(F.col("again"), "a row name is used twice")
        .when((F.col("kind") != "Which Trade") & (F.size("names") != 1), "not one row name")
    )
    rows = rows.withColumn("rule", flaw)
    refusals = g.where("rule is not null").select("file", F.lit(None).cast("int").alias("ord"), "rule").union(rows.where("rule is not null").select("file", "ord", "rule"))
    return g.where("rule is null").select("file", "title", "numbers", "homes", "otherwise"), rows.where("rule is null").select("file", "ord", "kind", "line", "condition", "look", "names"), refusals


def which_trade(rows: DataFrame, trades: Mapping[str, Sequence[str]], owners: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(halves, refusals) of the `Which Trade` rows of `scan_standard_lines`, by a dictionary of names, each for one trade or more.

    After each `by`, `with` or `Not` a list of names runs, joined by commas, `or` and `and`, an article before a name left out, up to the
    first piece between commas that has a name of neither the dictionary nor `owners`. A list after `by` or `with` is a half; its shape is `owner`
    where it names no trade, else `or` where `or` joins it, `each` for more than one trade, and `one`. Trades after `Not` are kept off, and so
    is one named just before a leading `Install`. Dictionaries are small and part of the plan; a condition names a trade by the dictionary too, in any case,
    the longest names first.

    halves: (file, ord, half, name, shape, trades, owner, kept_off, named, condition_trades), `half` from 0, `named` all trades of the line.
    refusals: (file, ord, rule): a list that begins with no known name, has both joiners, keeps the work off the owner, or names the owner beside
    a trade without `or`; a line without a half, or with an owner's half and not just one other; as many row names as halves there must be.
    """
    names, owned = F.array(*[F.lit(x) for x in trades]), F.array(*[F.lit(x) for x in owners])
    by_name = F.create_map(*[x for k, v in trades.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    none = F.array().cast("array<string>")
    # lines and conditions recur: each distinct one is read once, however many rows have it
    w = rows.where("kind = 'Which Trade'").select("file", "ord", "line", F.coalesce("condition", F.lit("")).alias("condition"), "names")
    texts = held(w.select("line", "condition").distinct())
    each = texts.select("line").where("line is not null").distinct().withColumn("parts", F.split("line", r"(?=\b(?:by|with|Not)\b)"))
    before = F.trim(F.get("parts", F.lit(0)))
    head = F.when(before.rlike("^.+ Install$"), F.substring(before, F.lit(1), F.length(before) - len(" Install")))
    kept_first = F.when(F.array_contains(names, head), F.element_at(by_name, head)).otherwise(none)
    each = each.withColumn("kept_first", F.coalesce(kept_first, none))

    part = each.select("line", F.posexplode("parts").alias("p", "part")).where(F.col("part").rlike(r"^(by|with|Not)\b"))
    word = F.regexp_extract("part", "^(by|with|Not)", 1)
    pieces = F.split(F.substring("part", F.length(word) + 1, F.length("part")), ",")
    read = F.transform(pieces, lambda x: F.struct(x.alias("text"), F.transform(_items(x, r"\b(?:or|and)\b"), lambda n: F.regexp_replace(n, "^(the|a|an) ", "")).alias("names")))
    part = part.select("line", "p", word.alias("word"), read.alias("pieces"))
    known = F.transform("pieces", lambda x: (F.size(x["names"]) > 0) & ~F.exists(x["names"], lambda n: ~(F.array_contains(names, n) | F.array_contains(owned, n))))
    stop = F.array_position(known, F.lit(False)).cast("int")
    taken = F.slice("pieces", F.lit(1), F.when(stop == 0, F.size("pieces")).otherwise(stop - 1))
    part = part.select("line", "p", "word", taken.alias("taken"))
    part = part.select("line", "p", "word", F.flatten(F.transform("taken", lambda x: x["names"])).alias("said"), F.exists("taken", lambda x: x["text"].rlike(r"\bor\b")).alias("or_"), F.exists("taken", lambda x: x["text"].rlike(r"\band\b")).alias("and_"))
    own = F.flatten(F.transform(F.filter("said", lambda n: F.array_contains(names, n)), lambda n: F.element_at(by_name, n)))
    part = part.withColumn("trades", own).withColumn("owner", F.exists("said", lambda n: F.array_contains(owned, n)))
    shape = F.when(F.size("trades") == 0, "owner").when(F.col("or_"), "or").when(F.size("trades") > 1, "each").otherwise("one")
    part = part.withColumn("shape", shape)
    flaw = F.when(F.size("said") == 0, "names no known trade").when(F.col("or_") & F.col("and_"), "joins one list with both words").when((F.col("word") == "Not") & F.col("owner"), "keeps the work off the owner").when((F.col("word") != "Not") & F.col("owner") & F.col("shape").isin("one", "each"), "names the owner beside a trade")
    part = part.withColumn("flaw", flaw)
    g = part.groupBy("line").agg(
        F.min(F.when(F.col("flaw").isNotNull(), F.struct("p", "flaw")))["flaw"].alias("flaw"), F.array_sort(F.collect_list(F.when(F.col("word") != "Not", F.struct("p", "shape", "trades", "owner")))).alias("h"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("word") == "Not", F.struct("p", "trades")))), lambda x: x["trades"])).alias("off"),
    )

    ordered = sorted(trades, key=lambda x: (-len(x), x))
    start = F.struct(F.col("condition").alias("rest"), none.alias("found"))

    def look(a, x):
        pattern = F.concat(F.lit(r"(?i)(?<![\w-])\Q"), x, F.lit(r"\E(?![\w-])"))
        hit = F.regexp_like(a["rest"], pattern)
        return F.struct(F.when(hit, F.regexp_replace(a["rest"], pattern, F.lit(" "))).otherwise(a["rest"]).alias("rest"), F.when(hit, F.array_union(a["found"], F.element_at(by_name, x))).otherwise(a["found"]).alias("found"))

    conditions = F.aggregate(F.array(*[F.lit(x) for x in ordered]), start, look, lambda a: a["found"])
    read = each.join(g, "line", "left").select("line", "flaw", F.coalesce("h", F.array().cast(g.schema["h"].dataType)).alias("h"), F.concat("kept_first", F.coalesce("off", none)).alias("off"))
    told = texts.select("condition").distinct().withColumn("condition_trades", conditions)
    j = w.join(_said(read), "line", "left").join(_said(told), "condition").withColumn("h", F.coalesce("h", F.array().cast(g.schema["h"].dataType))).withColumn("off", F.coalesce("off", none))
    owner_halves = F.size(F.filter("h", lambda x: x["shape"] == "owner"))
    rule = F.coalesce("flaw", F.when(F.size("h") == 0, "names no trade").when((owner_halves > 0) & ((F.size("h") != 2) | (owner_halves != 1)), "an owner half without one other half").when(F.size("h") != F.size("names"), "as many names as halves"))
    j = j.withColumn("rule", rule)
    good = j.where("rule is null").withColumn("named", F.array_distinct(F.concat("off", F.flatten(F.transform("h", lambda x: x["trades"])))))
    halves = good.select("file", "ord", "names", F.array_distinct("off").alias("kept_off"), "named", "condition_trades", F.posexplode("h").alias("half", "x"))
    halves = halves.select("file", "ord", "half", F.get("names", F.col("half")).alias("name"), "x.shape", "x.trades", "x.owner", "kept_off", "named", "condition_trades")
    return halves, j.where("rule is not null").select("file", "ord", "rule")


def half_writers(halves: DataFrame, carriers: DataFrame, places: DataFrame, homes: DataFrame) -> DataFrame:
    """(file, ord, half, shape, writers, records, left) of `which_trade`'s halves: the packages that write a half and what each puts beside its row.

    `carriers`: (file, ord, trade), the trades whose files carry the line; `places`: (trade, package), at most one row a trade, none or null for
    a trade that no package has; `homes`: (trade, home). A line involves its carriers and all trades that it or its condition names. A half's own
    packages are live; those of the other trades involved are the others. records: (writer, role, for_package, counterparty). `one`: its package writes, and
    an exclusion for each other names it; without one, the first other writes for all, with the home number of the half's trade, filled to three pairs. `or`:
    the first live package writes a note to itself, and exclusions to none. `each`: every live one writes, and is named. Where neither has a live
    one, the first other writes exclusions to none. An owner's half is written by the other half's writers, each an exclusion for itself
    to `owner`. left: work that nobody is named for yet. Packages are in the order of their names.
    """
    key = ["file", "ord"]
    own = halves.select(*key, F.explode(F.array_union("named", "condition_trades")).alias("trade")).union(carriers.select(*key, "trade")).distinct()
    placed = own.join(places.where("package is not null").select("trade", "package").distinct(), "trade")
    met = halves.select(*key, "half", "trades").join(placed, key, "left")
    mine = F.array_contains("trades", F.col("trade"))
    sets = met.groupBy(*key, "half").agg(F.array_sort(F.collect_set(F.when(mine, F.col("package")))).alias("live"), F.array_sort(F.collect_set(F.when(~mine, F.col("package")))).alias("rest"))
    h = halves.join(sets, [*key, "half"]).withColumn("others", F.array_except("rest", "live"))
    h = h.withColumn("_t", F.get("trades", F.lit(0))).join(homes.groupBy(F.col("trade").alias("_t")).agg(F.min("home").alias("home")), "_t", "left")
    pairs = F.split("home", " ")
    catalog = F.when(F.col("home").isNotNull(), F.array_join(F.concat(pairs, F.array_repeat(F.lit("00"), F.greatest(F.lit(3) - F.size(pairs), F.lit(0)))), " "))
    none = F.array().cast("array<struct<writer:string,role:string,for_package:string,counterparty:string>>")
    record = lambda w, role, p, c: F.struct(w.alias("writer"), F.lit(role).alias("role"), p.alias("for_package"), c.cast("string").alias("counterparty"))
    exclusions = lambda w, c: F.transform("others", lambda p: record(w, "exclusion", p, c))
    first, other = F.get("live", F.lit(0)), F.get("others", F.lit(0))
    is_live, has_other, shape = F.size("live") > 0, F.size("others") > 0, F.col("shape")
    writers = F.when(shape == "owner", F.array().cast("array<string>")).when((shape == "each") & is_live, F.col("live")).when(is_live, F.array(first)).when(has_other, F.array(other)).otherwise(F.array().cast("array<string>"))
    records = (
        F.when(shape == "owner", none).when((shape == "one") & is_live, exclusions(first, first)).when(shape == "one", exclusions(other, catalog))
        .when((shape == "or") & is_live, F.concat(F.array(record(first, "note", first, F.lit(""))), exclusions(first, F.lit("none"))))
        .when(is_live, F.flatten(F.transform("live", lambda w: exclusions(w, w)))).otherwise(exclusions(other, F.lit("none")))
    )
    h = h.select(*key, "half", "shape", writers.alias("writers"), records.alias("records"), ((shape != "owner") & ((shape == "or") | ~is_live)).alias("left"))
    beside = h.where("shape <> 'owner'").groupBy(*key).agg(F.min_by("writers", "half").alias("_w"))
    h = h.join(beside, key, "left")
    owners = F.transform("_w", lambda w: record(w, "exclusion", w, F.lit("owner")))
    return h.select(*key, "half", "shape", F.when(shape == "owner", F.col("_w")).otherwise(F.col("writers")).alias("writers"), F.when(shape == "owner", owners).otherwise(F.col("records")).alias("records"), "left")
