"""Line dedup on texts of very many lines: work and memory that grow with the lines, not with their square."""

import time

from tessera.llm import line_dedup


def word(k):
    return "".join(chr(97 + k // 26**j % 26) for j in range(4))


def test_texts_of_many_lines(spark):
    common = [f"the shared line {word(k)} of the page with more words" for k in range(20_000)]
    rows = [(i, "\n".join([*common, f"{word(i)} own words that no other text holds {word(i) * 2}"])) for i in range(6)]
    one = "\n".join(f"line {word(k)} stands in this text only {word(3 * k)}" for k in range(100_000))
    df = spark.createDataFrame([*rows, (9, one)], "doc_id long, text string").repartition(7)
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.perf_counter() - began < 90  # in 4,000 lines a text the square took all memory
    assert [(got[i]["lines_before"], got[i]["lines_dropped"], got[i]["text"]) for i in range(6)] == [(20_001, 20_000, rows[i][1].split("\n")[-1]) for i in range(6)]
    assert (got[9]["lines_before"], got[9]["lines_dropped"], got[9]["text"]) == (100_000, 0, one)


def test_lines_with_fields_go_in_near_copies(spark):
    """Before: near copies took no part, so there such lines stayed, also one that all the copies share."""
    line = lambda k: f"Posted by {word(97 * k)} in the forum today at noon"
    own = [" ".join(word(100_000 + 40 * i + j) for j in range(30)) for i in range(10)]
    body = [" ".join(word(200_000 + 40 * i + j) for j in range(30)) for i in range(4)]
    copy = lambda k: "\n".join(b + (f" {word(300_000 + k)}" if k % 4 == i else "") for i, b in enumerate(body))
    rows = [(i, line(i), t) for i, t in enumerate(own)]
    rows += [(100 + k, line(50), copy(k)) for k in range(8)] + [(200 + k, line(60 + k), copy(8 + k)) for k in range(8)]
    df = spark.createDataFrame([(i, f"{x}\n{t}") for i, x, t in rows], "doc_id long, text string")
    read = lambda copies: {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, False, copies).collect()}
    assert read(True) == {i: t for i, _, t in rows}
    # the SQL of op6 leaves them in the copies
    assert read(False) == {i: t if i < 100 else f"{x}\n{t}" for i, x, t in rows}


def test_the_pipeline_takes_them_out_of_near_copies(spark):
    import corpus_pipeline

    line = lambda k: f"Posted by {word(97 * k)} in the forum today at noon"
    rows = [(i, line(i), " ".join(word(100_000 + 40 * i + j) for j in range(30))) for i in range(10)]
    body = " ".join(word(200_000 + j) for j in range(30))
    rows += [(100 + k, line(50 + k), f"{body} {word(300_000 + k)}") for k in range(8)]
    df = spark.createDataFrame([(i, f"{x}\n{t}", "d", 0) for i, x, t in rows], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_lines(spark, df, "").collect()}
    assert got == {i: (t, len(t)) for i, _, t in rows}
