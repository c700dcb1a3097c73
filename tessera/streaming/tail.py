"""The tail of append-only logs as a stream, and a trigger on counts of their lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a log has appended so far is read in pieces: a file of name `<log>.<number>` for each, numbers from 0 on.
PIECE = r"([^/]+)\.(\d+)$"


def read_pieces(spark: SparkSession, path: str, files_at_a_time: int = 1000) -> DataFrame:
    """A stream of (log, seq, piece) of a folder's files `<log>.<number>`; a file of another name is passed over."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_at_a_time).load(path)
    name = F.input_file_name()
    return files.where(name.rlike(PIECE)).select(F.regexp_extract(name, PIECE, 1).alias("log"), F.regexp_extract(name, PIECE, 2).cast("long").alias("seq"), F.col("value").alias("piece"))


def _in_order(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, first: int, step, start: tuple, schema: list[str]):
    """Rows (number, text) in the order of their numbers from `first` on, each once: early ones wait in the state, later copies go."""
    due, held, waiting = state.get if state.exists else (first, json.dumps(start), "{}")
    held, waiting, out = json.loads(held), json.loads(waiting), []
    for frame in frames:
        for n, text in zip(frame.iloc[:, 1].tolist(), frame.iloc[:, 2].tolist(), strict=True):
            if n >= due:
                waiting.setdefault(str(int(n)), text)
    while str(due) in waiting:
        held = step(key[0], due, waiting.pop(str(due)) or "", held, out)
        due += 1
    state.update((due, json.dumps(held), json.dumps(waiting)))
    yield pd.DataFrame(out, columns=schema)


STATE = "due long, held string, waiting string"


def whole_lines(pieces: DataFrame) -> DataFrame:
    """A stream of (log, line_no, line) from one of (log, seq, piece): the lines of each log that are written to their end.

    What follows the last line break is held back until a later piece ends that line, across batches and restarts. Pieces may come
    in any order and more than once: one waits until those before it have come, a copy of one that was read adds nothing. Null
    pieces are empty; rows without a log or number are passed over. A log's state is its unfinished line and the pieces that wait.
    """

    def step(log, seq, text, held, out):
        count, rest = held
        *whole, rest = (rest + text).split("\n")
        out.extend((log, count + i + 1, line) for i, line in enumerate(whole))
        return [count + len(whole), rest]

    def run(key, frames, state):
        yield from _in_order(key, frames, state, 0, step, (0, ""), ["log", "line_no", "line"])

    rows = pieces.where("log is not null and seq is not null").select("log", "seq", "piece")
    return rows.groupBy("log").applyInPandasWithState(run, "log string, line_no long, line string", STATE, "append", GroupStateTimeout.NoTimeout)


def due_check_ins(lines: DataFrame, every: int = 4, counted: str = "pass:", marker: str = "checkin:") -> DataFrame:
    """A stream of (log, line_no, since) from one of (log, line_no, line): a row as soon as a check-in is due.

    That is at the `every`-th line opening with `counted` since the last one opening with `marker`; further ones make it no more
    due. Lines count in the order of their numbers, from 1, and each once, however they come; a log's state is two counts and
    the lines that wait for one before them.
    """

    def step(log, line_no, line, held, out):
        word = line.split(maxsplit=1)[:1]
        since = 0 if word == [marker] else held[0] + (word == [counted])
        if since == every and word == [counted]:
            out.append((log, line_no, since))
        return [since]

    def run(key, frames, state):
        yield from _in_order(key, frames, state, 1, step, (0,), ["log", "line_no", "since"])

    rows = lines.where("log is not null and line_no is not null").select("log", "line_no", "line")
    return rows.groupBy("log").applyInPandasWithState(run, "log string, line_no long, since long", STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The stream's rows so far, in a Parquet table at `path`; a further call with the same checkpoint goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
