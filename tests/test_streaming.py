"""Streams: whole lines across pieces and restarts, count triggers, writes that happen once."""

import random

import pytest

from tessera.streaming import once, tail


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)


def drained(spark, tmp_path, **kw):
    lines = tail.drain(tail.whole_lines(tail.read_pieces(spark, f"file://{tmp_path}/in", **kw)), f"file://{tmp_path}/lines", f"file://{tmp_path}/mark")
    return sorted(tuple(r) for r in lines.collect())


def test_half_lines_wait_across_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, a__0="one\ntw", b__1="late\n", b__2="x", other="no number")
    assert drained(spark, tmp_path) == [("a", 1, "one")]  # b waits for its first piece
    put(folder, a__1="o\n\nfour", b__0="first\nsec")
    got = drained(spark, tmp_path)  # another run of the query, from the checkpoint
    assert got == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, ""), ("b", 1, "first"), ("b", 2, "seclate")]
    put(folder, a__2="\n", b__3="\n")
    assert drained(spark, tmp_path) == sorted([*got, ("a", 4, "four"), ("b", 3, "x")])


@pytest.mark.parametrize("at_a_time", [1, 3])
def test_pieces_in_any_order_give_the_batch(spark, tmp_path, at_a_time):
    rng = random.Random(at_a_time)
    folder = tmp_path / "in"
    folder.mkdir()
    want, files = [], []
    for log in ("u", "v"):
        lines = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 6))) for _ in range(30)]
        want += [(log, i + 1, x) for i, x in enumerate(lines)]
        text = "\n".join(lines) + "\nnot yet"
        cuts = sorted(rng.sample(range(1, len(text)), 4))
        files += [(f"{log}.{i}", text[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, None], strict=True))]
    rng.shuffle(files)
    for name, text in files:
        (folder / name).write_text(text)
    assert drained(spark, tmp_path, files_at_a_time=at_a_time) == sorted(want)


def test_check_ins_fall_due_once(spark, tmp_path):
    lines = ["pass: a"] * 3 + ["dispatch x", "checkin: c"] + ["pass: b"] * 4 + ["pass: more", "checkin: d", "pass:", "passing"] + ["pass: e"] * 3
    rows = [("log", i + 1, x) for i, x in enumerate(lines)]
    random.Random(1).shuffle(rows)
    for k in range(0, len(rows), 5):  # in several files, and the first twice
        spark.createDataFrame(rows[k : k + 5] + rows[:2], "log string, line_no long, line string").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("log string, line_no long, line string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    got = tail.drain(tail.due_check_ins(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/mark").collect()
    assert sorted(tuple(r) for r in got) == [("log", 9, 4), ("log", 16, 4)]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, at long, v string")
    read = lambda: sorted(((r["k"], r["v"]) for r in spark.read.parquet(path).collect()), key=str)
    once.write_batch(batch((1, 2, "b"), (1, 1, "a"), (None, 1, "n")), 0, path, ["k"], ["at"])
    first = read()
    assert first == sorted([(1, "a"), (None, "n")], key=str)
    for _ in range(2):  # the second time as a replay of the same batch
        once.write_batch(batch((1, 0, "late"), (2, 1, "c"), (None, 0, "m")), 1, path, ["k"], ["at"])
        assert read() == sorted([*first, (2, "c")], key=str)


def test_a_stream_is_written_once(spark, tmp_path):
    rows = [(i % 7, i, f"v{i}") for i in range(40)]
    schema = "k long, at long, v string"
    for k in range(0, 40, 10):
        spark.createDataFrame(rows[k : k + 10], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    once.write_once(stream(), f"file://{tmp_path}/out", f"file://{tmp_path}/mark", ["k"], ["at"])
    once.write_once(stream(), f"file://{tmp_path}/out", f"file://{tmp_path}/again", ["k"], ["at"])  # a new run from the start
    got = [r["k"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]
    assert sorted(got) == list(range(7))
