"""K1, K4, K5: files of lines that are written whole or not at all, appended logs, and pass summaries as lines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.sources.plan import LEFT_OUT, NO_TRADE

SCHEMA = "file string, line_no long, line string"
#: Bytes copied at once where a log is appended to.
COPIED = 1 << 20


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: (name of the file, place of its lines, number of its first line)."""

    files: list[tuple[str, str, int]]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class LineWriter(DataSourceWriter):
    """Tasks write their lines beside the targets, under names of their own; only the commit of all of them puts files in place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        files, name, out, before = [], None, None, None
        try:
            for row in iterator:
                if out is None or row.file != name:
                    if out is not None:
                        out.close()
                    if row.file is None or row.file in ("", ".", "..") or "/" in row.file:
                        raise ValueError(f"not the name of a file: {row.file!r}")
                    name, before = row.file, None
                    place = f"{folder}/.{name}.{self.run}.{uuid.uuid4().hex}"
                    files.append((name, place, row.line_no))
                    out = system.open_output_stream(place)
                if before is not None and row.line_no < before:
                    raise ValueError(f"the lines of {name} are out of order: {row.line_no} comes after {before}")
                before = row.line_no
                out.write(((row.line or "") + "\n").encode())
        except BaseException:
            if out is not None:
                out.close()
            for _, place, _ in files:
                system.delete_file(place)
            raise
        if out is not None:
            out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, folder = _filesystem(self.path)
        parts: dict[str, list[tuple[int, str]]] = {}
        for m in messages:
            for name, place, first in m.files if m else []:
                parts.setdefault(name, []).append((first, place))
        for name, places in parts.items():
            target, places = f"{folder}/{name}", sorted(places)
            old = None if self.overwrite else system.get_file_info(target)
            if len(places) == 1 and (old is None or not old.is_file):
                system.move(places[0][1], target)
                continue
            whole = f"{folder}/.{name}.{self.run}.whole"
            with system.open_output_stream(whole) as out:
                if old is not None and old.is_file and old.size:
                    last = self._copy(system, target, out)
                    if last != b"\n":  # a log whose last line lacks its end gets it first
                        out.write(b"\n")
                for _, place in places:
                    self._copy(system, place, out)
            system.move(whole, target)
            for _, place in places:
                system.delete_file(place)

    @staticmethod
    def _copy(system, source: str, out) -> bytes:
        last = b""
        with system.open_input_stream(source) as f:
            while chunk := f.read(COPIED):
                out.write(chunk)
                last = chunk[-1:]
        return last

    def abort(self, messages: list[Staged | None]) -> None:
        system, _ = _filesystem(self.path)
        for m in messages:
            for _, place, _ in m.files if m else []:
                system.delete_file(place)


class LineFiles(DataSource):
    """`line_files`: rows (file, line_no, line) as files of lines under `path`, in a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], overwrite)


def write_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    """K1, K4: the files of `lines` (file, line_no, line) under `path`, each whole: a job that fails leaves all as it was.

    A file's lines are in the order of line_no, null lines empty. A new file takes the place of the old; with `append` the lines
    follow it, after the end of its last line where that lacks one. Other files stay. Null, empty or nested names are refused.
    """
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(LineFiles)
    ordered = lines.select("file", F.col("line_no").cast("long").alias("line_no"), "line").repartition("file").sortWithinPartitions("file", "line_no")
    ordered.write.format("line_files").mode("append" if append else "overwrite").save(path)


FIELDS = ("created", "items", "updated", "questions", "replied", "conflicts")


def render_summaries(units: DataFrame, trades: DataFrame, ledgers: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """K5: (file, line_no, line): the summary of each pass, in the format that `scan_summaries` reads.

    `units`: (file, window, pass, ord, unit, created, items, updated, questions, replied, conflicts, reads, result), a unit each, figures null
    where it has no verified line; `trades`: (file, code, n); `ledgers`: (file, ledger, last_line, lines, hash); `notes`: (file, ord, kind, unit, clause).
    The lines are, in order: the header, the units read, one for each unit (with how often it was read, from the second time on), totals, trades, by count
    down and then code, units with conflicts, notes by kind, and the ledger. Passes without a row in `ledgers` have no ledger lines.
    """
    c = F.col
    read = c("result").isNotNull()
    figures = F.concat_ws(" ", *[F.concat(F.lit(f"{f} "), F.when(read, F.coalesce(c(f), F.lit(0)).cast("string")).otherwise("-")) for f in FIELDS])
    again = F.when(c("reads") > 1, F.concat(F.lit(" read "), c("reads").cast("string"))).otherwise("")
    unit = F.concat(F.lit("per unit: "), "unit", F.lit(" "), figures, again, F.lit(" verified "), F.when(c("result") == "ok", "yes").otherwise("no"))
    row = F.struct(c("ord").cast("long").alias("ord"), "unit", unit.alias("line"), (c("conflicts") > 0).alias("conflict"))
    total = [F.coalesce(F.sum(F.when(read, c(f))), F.lit(0)).alias(f) for f in FIELDS]
    g = units.groupBy("file").agg(F.min("window").alias("window"), F.min("pass").alias("pass"), F.array_sort(F.collect_list(row)).alias("u"), *total)
    named = lambda rows: F.array_join(F.transform(rows, lambda x: x["unit"]), ", ")
    s = lambda name: c(name).cast("string")
    totals = F.concat(F.lit("totals verified: created "), s("created"), F.lit(" (entry count under the unit prefixes), items "), s("items"), F.lit(" (reader's own item count), updated "), s("updated"), F.lit(", questions "), s("questions"), F.lit(" replied "), s("replied"))
    conflicts = F.when(c("conflicts") > 0, F.concat(F.lit("conflicting rows: "), s("conflicts"), F.lit(", on units "), named(F.filter("u", lambda x: x["conflict"])))).otherwise("conflicting rows: none")
    head = g.select("file", F.array(
        F.concat(F.lit("window: "), "window", F.lit("   pass: "), "pass"), F.concat(F.lit("units read: "), named("u")),
    ).alias("a"), F.transform("u", lambda x: x["line"]).alias("b"), totals.alias("t"), conflicts.alias("k"))
    sold = trades.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("n")).alias("m"), "code"))), lambda x: F.concat(x["code"], F.lit(" x"), (-x["m"]).cast("string"))), ", ").alias("x"))
    out = head.join(sold, "file", "left").withColumn("t", F.array("t", F.coalesce(F.concat(F.lit("trades: "), "x"), F.lit(NO_TRADE)), "k"))
    ledger = ledgers.select("file", F.array(F.concat(F.lit("ledger: "), "ledger", F.lit(", appended through "), F.coalesce("last_line", F.lit("nothing"))), F.concat(F.lit("ledger lines: "), s("lines"), F.lit(" sha256 "), "hash")).alias("l"))
    out = out.join(ledger, "file", "left")
    none = F.array().cast("array<string>")
    if notes is not None:
        text = F.concat(c("kind"), F.lit(": "), F.when(c("unit").isNotNull(), F.concat("unit", F.lit(" "))).otherwise(""), "clause")
        told = notes.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", c("ord").cast("long").alias("ord"), text.alias("line")))), lambda x: x["line"]).alias("n"))
        out = out.join(told, "file", "left")
    lines = F.concat("a", "b", "t", F.coalesce("n", none) if notes is not None else none, F.coalesce("l", none))
    return out.select("file", F.posexplode(lines).alias("line_no", "line"))


def render_plans(units: DataFrame, left_out: DataFrame) -> DataFrame:
    """K3: (file, line_no, line): read plans, in the format that `scan_plan` reads.

    `units`: (file, window, pass_ord, pass, title, reads_for, ord, unit, text, verified); `left_out`: (file, ord, text, why). A plan has its header; a block for every
    pass, in order, with its fields (window, what it reads for, units, units verified) and a line a unit, by its id, or in window 3 by its
    place; then what was left out, by place, or a line for nothing; then the totals. A file without units has no plan. Null texts are empty.
    """
    c, s = F.col, lambda x: F.coalesce(x.cast("string"), F.lit(""))
    line = F.when(c("window") == "3", F.concat(s(c("ord")), F.lit(". "), "unit", F.lit(": "), s(c("text")))).otherwise(F.concat("unit", F.lit(". "), s(c("text"))))
    blocks = units.groupBy("file", "window", "pass_ord", "pass", "title", "reads_for").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("u"), F.count_if(F.coalesce("verified", F.lit(False))).alias("done"))
    head = F.array(F.concat(F.lit("### "), "pass", F.lit(". "), s(c("title"))), F.lit(""), F.concat(F.lit("window: "), "window"), F.concat(F.lit("reads for: "), s(c("reads_for"))), F.concat(F.lit("units: "), F.size("u").cast("string")), F.concat(F.lit("units verified: "), c("done").cast("string")), F.lit(""))
    blocks = blocks.select("file", "window", "pass_ord", F.concat(head, F.transform("u", lambda x: x["line"]), F.array(F.lit(""))).alias("lines"), F.size("u").alias("n"))
    plans = blocks.groupBy("file").agg(F.min("window").alias("window"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pass_ord", "lines"))), lambda x: x["lines"])).alias("blocks"), F.sum("n").alias("units"), F.count("*").alias("passes"))
    skipped = left_out.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text", "why"))), lambda x: F.concat(x["ord"].cast("string"), F.lit(". "), F.coalesce(x["text"], F.lit("")), F.lit(": "), F.coalesce(x["why"], F.lit("")))).alias("skipped"))
    j = plans.join(skipped, "file", "left")
    start = F.array(F.concat(F.lit("# Read plan: window "), "window"), F.lit(""), F.concat(F.lit("## Window "), "window"), F.lit(""))
    end = F.array(F.lit(""), F.lit("## Totals"), F.lit(""), F.concat(F.lit("units planned "), c("units").cast("string"), F.lit(", passes "), c("passes").cast("string")))
    lines = F.concat(start, "blocks", F.array(F.lit(LEFT_OUT), F.lit("")), F.coalesce("skipped", F.array(F.lit("Nothing. This window left nothing out by pattern."))), end)
    return j.select("file", F.posexplode(lines).alias("line_no", "line"))
