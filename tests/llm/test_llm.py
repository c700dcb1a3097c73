"""Operators against brute force and round trips on small fixtures, with nulls, empty and long texts, ties, repeats and empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, components, dac, decontaminate, elias_fano, language_model, line_dedup, packing, quality, simhash, token_counts, toxicity
from tessera.llm.tokens import coder, default_path

SCHEMA = "doc_id long, text string, score double, drop string, leaf string"
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def prose(rng, n, words=400):
    name = lambda k: "w" + "".join(chr(97 + k // 26**j % 26) for j in range(3))
    return " ".join(name(int(rng.paretovariate(0.7)) % words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(5, 120)) + ".\nNext line " + prose(rng, 8) for _ in range(40)]
    base += [base[0], base[1] + " extra", "", None, "x", "<|endoftext|> a<|endoftext|>", "É́t  tab\tend \n\n ", prose(rng, 30_000), "don't I'll 12 34"]
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, "d", "l") for i, t in enumerate(texts)] + [(None, "no id here at all", 1.0, None, None), (3, texts[3], 0.0, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lib_ids(name, text):
    return coder(default_path(name)).lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_coder_equals_library(name, texts):
    c = coder(default_path(name))
    got = c.ids_many([t or "" for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib_ids(name, t) for t in texts]


def test_token_counts(spark, docs, none, texts, tmp_path):
    path = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time all are known
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, default_path(BYTES), path).collect())
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(lib_ids(BYTES, r["text"]))) for r in docs.collect())
        assert got == want
    assert spark.read.parquet(path).groupBy("digest").count().where("count > 1").isEmpty()
    assert token_counts.count_tokens(none, default_path(BYTES), path).isEmpty()


def test_token_file_round_trip(spark, docs, none, tmp_path):
    dac.write_tokens(docs, default_path(BYTES), f"file://{tmp_path}/t")
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in dac.read_tokens(spark, f"file://{tmp_path}/t").collect()))
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array([*lib_ids(BYTES, r["text"]), 2], "<u4")
        want.append((r["doc_id"] is not None, r["doc_id"] or 0, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    dac.write_tokens(none, default_path(BYTES), f"file://{tmp_path}/e")
    assert dac.read_tokens(spark, f"file://{tmp_path}/e").isEmpty()


def test_codes_give_any_token(tmp_path):
    ids = np.random.default_rng(1).choice([3, 255, 256, 70_000, 2**31], 5000).astype(np.uint32)
    (tmp_path / "x").write_bytes(dac.encode(ids, [1, None], np.array([2000, 3000]), 4, 77) + b"\n")
    r = dac.Reader(np.memmap(tmp_path / "x", dtype=np.uint8, mode="r"))
    at = np.random.default_rng(2).integers(0, 5000, 800)
    assert (r.get(at) == ids[at]).all() and (r.get(np.arange(5000)) == ids).all() and (r.document(1) == ids[2000:]).all()
    assert (r.doc_ids, r.shard, r.before, r.crcs()) == ([1, None], 4, 77, [zlib.crc32(ids[:2000].tobytes()), zlib.crc32(ids[2000:].tobytes())])
    assert len(dac.Reader(dac.encode(ids[:0], [], np.zeros(0, np.int64))).get([])) == 0
    with pytest.raises(ValueError, match="not a file"):
        dac.Reader(b"")


def test_token_files_are_addressable(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "ACCESS_IDS", 500)
    path = f"file://{tmp_path}/t"
    dac.write_tokens(docs, default_path(WORDS), path)
    want = []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        want += [*lib_ids(WORDS, r["text"]), 2]
    asked = [0, 5, 5, len(want) - 1, 1234, len(want), -1, None]
    got = dac.get_tokens(spark, path, spark.createDataFrame([(x,) for x in asked], "place long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, want[x]) for x in asked if x is not None and 0 <= x < len(want))
    # a stored code that changes changes what is read
    at = max(tmp_path.glob("t/part-*"), key=lambda f: f.stat().st_size)
    before = dac.read_tokens(spark, path).agg(F.sum("ids_crc32")).first()[0]
    raw = bytearray(at.read_bytes())
    r = dac.Reader(bytes(raw))
    raw[raw.find(r.levels[0][1][:64].tobytes())] ^= 1
    at.write_bytes(bytes(raw))
    (at.parent / f".{at.name}.crc").unlink(missing_ok=True)
    assert dac.read_tokens(spark, path).agg(F.sum("ids_crc32")).first()[0] != before


def test_packing_holds_limits(docs, none):
    rows = packing.pack(docs, default_path(WORDS), max_tokens=256, max_segments=4, max_loss=250).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    whole = {}
    for r in docs.collect():
        ids = np.array([*lib_ids(WORDS, r["text"]), 2], "<u4")
        whole.setdefault((r["doc_id"], len(ids)), []).append(ids)
    assert set(whole) == set(by_doc)
    for key, pieces in by_doc.items():
        crcs = {(a, b): {zlib.crc32(x[a:b].tobytes()) for x in whole[key]} for a, b in {(p["start"], p["start"] + p["length"]) for p in pieces}}
        assert all(p["ids_crc32"] in crcs[p["start"], p["start"] + p["length"]] for p in pieces)
        if len(whole[key]) == 1:  # gapless
            pieces.sort(key=lambda p: p["start"])
            assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()] and sum(p["length"] for p in pieces) == key[1]
    for seq in by_seq.values():
        seq.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in seq] == np.concatenate([[0], np.cumsum([r["length"] for r in seq])[:-1]]).tolist()
        total = sum(r["length"] for r in seq)
        assert total == 256 or total & (total - 1) == 0  # no padding
        assert total <= 256 and len(seq) <= 4 and sum(r["loss_tokens"] for r in seq) <= 250
    assert sum(r["length"] for r in rows) == sum(len(x) for v in whole.values() for x in v)
    assert packing.pack(none, default_path(WORDS)).isEmpty()


def test_packing_of_prompts_binds_on_loss(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(1, 60)), prose(rng, rng.randint(0, 200)) if i % 3 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, question string").coalesce(1)
    got = packing.pack(df, default_path(WORDS), max_tokens=512, max_segments=8, max_loss=100, prompt="question").collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    use = [(sum(r["length"] for r in q), len(q), sum(r["loss_tokens"] for r in q)) for q in seqs.values()]
    assert all(t <= 512 and n <= 8 and k <= 100 and (t == 512 or t & (t - 1) == 0) for t, n, k in use)
    assert any(k == 100 and t < 512 for t, _, k in use)  # the loss-bearing tokens bind
    loss = sum(len(lib_ids(WORDS, t)) + 1 - (0 if lib_ids(WORDS, q or "") else 1) for _, t, q in rows)
    assert sum(k for _, _, k in use) == loss
    with pytest.raises(ValueError, match="at least 1"):
        packing.pack(df, default_path(WORDS), max_loss=0)


def test_packing_many_tiny_texts_is_linear():
    import time

    took = []
    for n in (20_000, 40_000):
        p = packing.Packer(4096, 512, 4096)
        began = time.perf_counter()
        for i in range(n):
            list(p.add(i, memoryview(b"abcd"), 1, 1))
        out = list(p.drain(last=True))
        took.append(time.perf_counter() - began)
        assert sum(len(x) for x in out) == n
    assert took[1] < 4 * took[0] + 0.5


def test_covering_masks_cover():
    rng = random.Random(1)
    for bits, radius in ((64, 2), (48, 5)):
        family = simhash.masks(bits, radius)
        assert len(family) == 2 ** (radius + 1) - 1
        for _ in range(500):
            diff = sum(1 << i for i in rng.sample(range(bits), radius))
            assert any(not diff & m for m in family)


def groups(values, radius):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_lose_none(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = list({s ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(12)} | {0})
    prints = spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)] + [(None, simhash._signed(values[0])), (99_999, simhash._signed(values[0]))], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(prints).collect()}
    want = groups(values, 2)
    assert [got[i] for i in range(len(values))] == want and got[None] == got[99_999] == want[0]


def test_components_settle(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (501, 500), (500, 501)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[501] == 500 and got[2049] == 2000
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_near_copies(spark, none):
    rng = random.Random(9)
    a = prose(rng, 300, 5000).split()
    b = a.copy()
    b[100] = "changed"
    rows = [(5, " ".join(a)), (2, " ".join(b)), (7, prose(rng, 300, 5000)), (8, ""), (9, None), (None, " ".join(a))]
    df = spark.createDataFrame([(i, t, 0.0, "", "") for i, t in rows], SCHEMA)
    assert {(r["doc_id"], r["keeper"]) for r in simhash.copies(df).collect()} == {(5, 2), (9, 8)}
    assert sorted(str(r["doc_id"]) for r in simhash.drop_copies(df).collect()) == ["2", "7", "8", "None"]
    assert simhash.drop_copies(none).isEmpty()


def test_stranger_between_copies_hides_none(spark, monkeypatch):
    # one bucket: the first text is a stranger, and another lies between two copies
    monkeypatch.setattr(simhash, "masks", lambda bits, radius: [0])
    rng = random.Random(11)
    a = prose(rng, 300, 5000).split()
    texts = [prose(rng, 300, 5000), " ".join(a), prose(rng, 300, 5000), " ".join(a[:-1])]
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r["doc_id"], r["keeper"]) for r in simhash.copies(df).collect()} == {(4, 2)}


def test_copies_are_judged_by_texts(spark):
    # pairs on either side of the similarity, which the fingerprints' mean distance takes for the other
    rng = random.Random(21)
    texts, want = [], set()
    for k in range(40):
        a = [f"{k}x{i}" for i in range(204)]
        cut = 177 if k % 2 else 158  # of 200 shingles, the first ones stay
        b = a[:cut] + [f"{k}y{i}" for i in range(204 - cut)]
        s = lambda u: {tuple(u[i : i + 5]) for i in range(len(u) - 4)}
        if len(s(a) & s(b)) / len(s(a) | s(b)) >= 0.8:
            want.add((2 * k + 1, 2 * k))
        texts += [" ".join(a), " ".join(b)]
    assert len(want) == 0
    for k in range(40, 60):
        a = [f"{k}x{i}" for i in range(204)]
        b = a[:183] + [f"{k}y{i}" for i in range(21)]
        assert len(s(a) & s(b)) / len(s(a) | s(b)) >= 0.8
        want.add((2 * k + 1, 2 * k))
        texts += [" ".join(a), " ".join(b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["keeper"]) for r in simhash.copies(df).collect()} == want


def test_bucket_pairs():
    rng = random.Random(12)
    one, other, third = ([rng.getrandbits(48) for _ in range(3)] for _ in range(3))
    rows = [(7, 1, *third), (7, 2, *one), (7, 3, *other), (7, 4, *one)] + [(8, k, *[rng.getrandbits(48) for _ in range(3)]) for k in range(1200)] + [(8, 2000, *one), (9, 5, *one)]
    rows.insert(5, (8, -5, *one))
    cols = list(zip(*rows, strict=True))
    table = pa.table([pa.array(c, pa.int64()) for c in cols], names=["key", "node", "f0", "f1", "f2"])
    found = set()
    for key, node, *prints in simhash.runs(table.to_batches(max_chunksize=100)):
        for x, y in simhash.close(key, node, np.stack(prints, 1).view(np.uint64), 21):
            found |= {tuple(sorted((int(node[i]), int(node[j])))) for i, j in zip(x, y, strict=True)}
    assert found == {(2, 4), (-5, 2000)}


def test_decontamination_against_brute_force(spark, none):
    rng = random.Random(2)
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate([40, 40, 25, 60, 3])] + [(9, None), (None, "x y z")]
    clean = prose(rng, 500, 3000)
    near = items[3][1].split()
    near[0] = "other"
    rows = [(1, clean + " " + items[0][1].upper() + " " + clean), (2, clean), (3, " ".join(near)), (4, "a " + items[4][1] + " b"), (5, None), (6, ""), (1, items[2][1])]
    df = spark.createDataFrame([(i, t, 0.0, "", "") for i, t in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        w = (t or "").lower().split()
        for k, x in items:
            v = (x or "").split()
            if k is None or not v:
                continue
            s = lambda u: Counter(tuple(u[j : j + 5]) for j in range(len(u) - 4)) if len(u) >= 5 else Counter([tuple(u)])
            for j in range(len(w) - len(v) + 1):
                p, q = s(w[j : j + len(v)]), s(v)
                if sum((p & q).values()) / sum((p | q).values()) >= 0.8:
                    want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == want
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()} == {2, 5, 6}
    assert decontaminate.find_leaks(none, bench).isEmpty() and decontaminate.find_leaks(df, bench.limit(0)).isEmpty()


def test_decontamination_of_texts_shorter_than_an_item(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate([59, 30, 12])]
    rows = [(100 * k + n, " ".join(x.split()[:n])) for k, x in items for n in range(1, len(x.split()) + 1)]
    s = lambda u: Counter(tuple(u[j : j + 5]) for j in range(len(u) - 4)) if len(u) >= 5 else Counter([tuple(u)])
    want = set()
    for i, t in rows:
        for k, x in items:
            w, v = t.split(), x.split()
            n = min(len(w), len(v))
            if any(sum((s(w[j : j + n]) & s(v)).values()) / sum((s(w[j : j + n]) | s(v)).values()) >= 0.8 for j in range(len(w) - n + 1)):
                want.add((i, k, n))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert (54, 0, 54) in want
    assert {(r["doc_id"], r["item_id"], r["n_words"]) for r in decontaminate.find_leaks(df, bench).collect()} == want
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()} == {i for i, _ in rows} - {i for i, _, _ in want}


def test_line_templates_drop_across_documents(spark, none):
    rng = random.Random(4)
    rows = [(i, f"Page {i} of 90 seen\n{prose(rng, 20, 9000)}\n\nshort") for i in range(8)]
    copy = "same body in every copy\nand a second line of it"
    rows += [(100 + i, copy) for i in range(9)] + [(200, None), (201, ""), (None, "Page 7 of 90 seen\nown words are here"), (0, rows[0][1]), (202, "\n".join(prose(rng, 9, 9000) for _ in range(3000)))]
    df = spark.createDataFrame([(i, t, 0.0, "d", "l") for i, t in rows], SCHEMA)
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "lines_before", "lines_dropped"] and got.count() == len(rows)
    out = {r["doc_id"]: r for r in got.collect()}
    assert "Page" not in out[3]["text"] and out[3]["text"].endswith("\n\nshort") and out[3]["lines_dropped"] == 1
    assert out[104]["text"] == copy and out[200]["text"] is None and out[201]["text"] == "" and out[None]["text"] == "own words are here"
    assert out[202]["text"] == rows[-1][1] and out[202]["lines_before"] == 3000
    assert line_dedup.dedup_lines(none).isEmpty()
    clash = df.selectExpr("*", "1 AS lines_before", "2 AS b1", "3 AS `row`", "4 AS `a.b`")
    assert line_dedup.dedup_lines(clash).columns == [*clash.columns, "lines_dropped"]
    assert line_dedup.dedup_lines(clash, report=False).columns == clash.columns and line_dedup.dedup_lines(clash, report=False).where("b1 <> 2 OR `row` <> 3 OR `a.b` <> 4").isEmpty()


def words_only(rng, n):
    """Words of letters alone, nearly all different."""
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("lines", [1, 3, 12])
@pytest.mark.parametrize("length", [4, 12, 60])
def test_blocks_of_recurring_lines_go(spark, lines, length):
    rng = random.Random(lines)
    block = [f"footer line {chr(97 + k)} of the whole site" for k in range(lines)]
    own = [words_only(rng, length) for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join([*block[: i % (lines + 1)], x, *block[i % (lines + 1) :]])) for i, x in enumerate(own)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == dict(enumerate(own))


def test_fields_without_marks_are_generalised(spark):
    rng = random.Random(8)
    names = ["alice", "bob", "carol", "dave", "erin", "frank", "grace", "heidi", "ivan", "judy"]
    line = lambda x: f"Posted by {x} in the forum today"
    alone = spark.createDataFrame([(i, line(x)) for i, x in enumerate(names)], "doc_id long, text string")
    assert {r["text"] for r in line_dedup.dedup_lines(alone).collect()} == {""}
    some = [words_only(rng, 14) for _ in names]
    with_own = spark.createDataFrame([(i, line(x) + "\n" + y) for i, (x, y) in enumerate(zip(names, some, strict=True))], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(with_own).collect()) == sorted(some)
    marked = spark.createDataFrame([(i, line(f"user{i}")) for i in range(10)], "doc_id long, text string")
    assert {r["text"] for r in line_dedup.dedup_lines(marked).collect()} == {""}
    # four texts do not make a template; neither do lines that share less than three quarters
    few = spark.createDataFrame([(i, line(x)) for i, x in enumerate(names[:4])] + [(10 + i, f"Posted by {words_only(rng, 3)} today here now") for i in range(9)], "doc_id long, text string")
    assert line_dedup.dedup_lines(few).where("lines_dropped > 0").isEmpty()


def test_near_copies_keep_their_lines(spark):
    rng = random.Random(17)
    block = [f"footer line {chr(97 + k)} of the site" for k in range(12)]
    rows = [(i, "\n".join([prose(rng, 60, 9000), *block])) for i in range(20)]
    body, shared = [prose(rng, 40, 9000) for _ in range(8)], "one line that others have too"
    for k in range(60):  # near copies, each with a word of its own in one line
        own = list(body)
        own[k % 8] += " word" + chr(97 + k // 26) + chr(97 + k % 26)
        rows.append((1000 + k, "\n".join([*own, shared])))
    rows += [(2000 + k, prose(rng, 60, 9000) + "\n" + shared) for k in range(4)]
    df = spark.createDataFrame([(i, t, 0, "d") for i, t in rows], "doc_id long, text string, n_chars long, source string")
    want = {i: "\n".join(x for x in t.split("\n") if x not in block and x != shared) for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, report=False).collect()} == want


def test_line_dedup_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(31)
    pool = [f"line {words_only(rng, rng.randint(1, 9))} end {k}" for k in range(12)] + ["Seen by {} at the main gate of town", "{} entered the old house by the door", "No {} here", "", "x"]
    rows = [(i if i % 17 else None, None if i % 40 == 3 else "\n".join(rng.choice(pool).format(words_only(rng, 1)) for _ in range(rng.randint(0, 6))) + rng.choice(["", "\n" + words_only(rng, 11)])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(df).collect()), key=key)
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})  # noqa: F841  the SQL's table
    want = sorted(duckdb.sql(line_dedup.OP6_SQL).fetchall(), key=key)
    assert got == want and any(r[3] for r in got)


def labelled(spark, bad):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        y = i % 3 == 0
        t = prose(rng, 60)
        rows.append((i, bad(t, rng) if y else t, None, "", ""))
        labels.append((i, int(not y), int(y)))
    return spark.createDataFrame([*rows, (1000, None, None, "", ""), (1001, "", None, "", ""), (None, "wba wca", None, "", "")], SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark, none):
    docs, labels = labelled(spark, lambda t, rng: t.upper() + " $$$ ###")
    rules = quality.fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in quality.score(docs, rules).collect()}
    assert all(got[i]["predicted"] == int(i % 3 != 0) for i in range(300)) and 0 <= got[1000]["score"] == got[1001]["score"] <= 1
    assert quality.score(none, rules).isEmpty() and quality.fit(docs, labels.limit(0), F.lit(True)).rules == []


def test_toxicity(spark, none):
    docs, labels = labelled(spark, lambda t, rng: " ".join(x if rng.random() > 0.15 else rng.choice(["slurword", "vileterm", "badnoun"]) for x in t.split()))
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    right = sum((got[i]["predicted"] == 1) == (i % 3 == 0) for i in range(300))
    assert right >= 290 and len(got) == 303 and got[1000]["score"] == got[1001]["score"]
    assert toxicity.score(none, model).isEmpty() and toxicity.fit(docs, labels.limit(0), F.lit(True)) is None
    assert toxicity.reject(docs, model).columns == docs.columns


@pytest.mark.parametrize(("n", "top"), [(3000, 10**9), (3000, 5000), (1, 7), (700, 2**62)])
def test_elias_fano(n, top):
    x = np.sort(np.random.default_rng(3).integers(0, top, n))
    s = elias_fano.Sequence(elias_fano.Sequence.encode(x))
    assert (s.get(np.arange(n)) == x).all()
    asked = np.random.default_rng(4).integers(0, top, 500)
    assert (s.successor(asked, 0, n) == np.searchsorted(x, asked)).all()
    lo, hi = n // 3, n - n // 4
    assert (s.successor(asked, lo, hi) == np.clip(np.searchsorted(x, asked), lo, hi)).all()
    assert elias_fano.Sequence(elias_fano.Sequence.encode(x[:0])).n == 0


def test_trie_searches_within_contexts(tmp_path):
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0)
    contexts, vocabulary = np.unique(rng.integers(0, 10**12, 60)), np.unique(rng.integers(0, 10**12, 60))
    pairs = pairs[(pairs < min(len(contexts), len(vocabulary))).all(1)]
    logp, backoff = -np.arange(len(pairs)) / 300, -np.arange(len(contexts)) / 60
    (tmp_path / "t").write_bytes(elias_fano.Trie.build(contexts, backoff, vocabulary, pairs[:, 0], pairs[:, 1], logp))
    t = elias_fano.Trie(np.memmap(tmp_path / "t", dtype=np.uint8, mode="r"))
    more_v, more_w = np.append(contexts, 5).astype(np.uint64), np.append(vocabulary, 10**13).astype(np.uint64)
    x, y = rng.integers(0, len(more_v), 800), rng.integers(0, len(more_w), 800)
    lower = -rng.random(len(more_w)) * 5
    got = t.log_p(more_v, x, more_w, y, lower)
    held = {(a, b): p for (a, b), p in zip(pairs.tolist(), logp, strict=True)}
    for a, b, g in zip(x.tolist(), y.tolist(), got, strict=True):
        want = held[a, b] if (a, b) in held else (backoff[a] if a < len(contexts) else 0) + lower[b]
        assert abs(g - want) <= 0.026


def test_scores_are_read_from_the_stored_trie(spark, docs, monkeypatch, tmp_path):
    learns = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    plain = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language_model.score(docs, learns, ~learns, f"file://{tmp_path}/one").collect()}
    direct = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language_model.score(docs, learns, ~learns).collect()}
    assert plain.keys() == direct.keys() and all(abs(plain[k] - direct[k]) < 1e-6 for k in plain)
    stage = language_model.store.stage

    def corrupt(df, name, path=None):
        out = stage(df, name, path)
        if name != "lm-model":
            return out

        def run(batches):
            for b in batches:
                images = []
                for x in b.column(1).to_pylist():
                    if x is None:
                        images.append(None)
                        continue
                    t = elias_fano.Trie(x)
                    images.append(x[: len(x) - t.raised.n] + bytes(255 - c for c in x[len(x) - t.raised.n :]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(images, pa.binary()), b.column(2), b.column(3)], names=b.schema.names)

        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(language_model.store, "stage", corrupt)
    other = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language_model.score(docs, learns, ~learns, f"file://{tmp_path}/two").collect()}
    assert plain.keys() == other.keys() and sum(abs(plain[k] - other[k]) > 0.5 for k in plain) > 30


def test_language_model_against_brute_force(spark, docs, none):
    learns = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = language_model.score(docs, learns, ~learns).collect()
    rows = docs.collect()
    cut = lambda t: [*(t or "").translate({i: i + 32 for i in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" "), "\n"]
    cut2 = lambda t: [x for x in cut(t) if x]
    uni, bi, starts = Counter(), Counter(), 0
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] % 3:
            w = cut2(r["text"])
            uni.update(w)
            bi.update(zip([None, *w], w))
            starts += 1
    n, v = sum(uni.values()), len(uni)
    n1, n2 = (sum(c == k for c in uni.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2)
    want = Counter()
    for r in rows:
        w = cut2(r["text"])
        s = 0
        for a, b in zip([None, *w], w):
            p, c = ((uni[b] - d) / n if uni[b] else d * v / n), starts if a is None else uni[a]
            m = c**language_model.BACKOFF
            s += np.log10((bi[a, b] + m * p) / (c + m)) if c else np.log10(p)
        want[r["doc_id"], len(w), sum(uni[x] > 0 for x in w), round(sum(np.log10((uni[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
        near = [g for g in got if g["doc_id"] == r["doc_id"]]
        assert all(abs(g["score"] - s) <= 0.026 * len(w) for g in near) and near
    assert Counter((g["doc_id"], g["n_tokens"], g["n_known"], round(g["base_score"], 4)) for g in got) == want
    assert {g["train_tokens"] for g in got} == {n}
    assert language_model.score(none, learns, ~learns).isEmpty()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 9))
    x[100:200] = x[100] + rng.normal(size=(100, 9)) * 0.01
    x[300:340] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [0.0] * 9), (1000, [float("nan")] * 9), (1050, [1.0, None]), (1100, []), (None, x[0].tolist())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    right = 0
    for i in range(0, 700, 50):
        s = np.round(unit @ unit[i], 12)
        s[i] = -9
        want = np.lexsort((np.arange(700), -s))[:5]
        right += len({got[i][k][0] for k in range(1, 6)} & set(want.tolist()))
        assert all(abs(got[i][k][1] - unit[got[i][k][0]] @ unit[i]) < 1e-9 for k in range(1, 6))
    assert set(got) == set(range(0, 700, 50)) and right >= 0.9 * 5 * 14
    assert [got[300][k][0] for k in range(1, 6)] == [301, 302, 303, 304, 305]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).isEmpty()


def test_repeated_ids_are_one_query_and_one_candidate(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (0, x[7].tolist()), (5, x[9].tolist()), (5, x[5].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q in (0, 50):
        best = {}
        for i, v in rows:
            for j, w in rows:
                if i == q and j != q:
                    best[j] = max(best.get(j, -9), round(float(unit(v) @ unit(w)), 12))
        want = sorted(best, key=lambda j: (-best[j], j))[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_fingerprints_against_brute_force(spark, docs):
    import xxhash

    want = Counter()
    for r in docs.collect():
        w = re.findall("[^\\x20\\x09-\\x0d]+", (r["text"] or "").translate({i: i + 32 for i in range(65, 91)}))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        want[r["doc_id"], sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))] += 1
    assert Counter((r["doc_id"], r["fp"] % 2**64) for r in simhash.xxh_fingerprints(docs).collect()) == want


def test_rules_as_columns_equal_their_matrix(spark, docs):
    rng = random.Random(12)
    rows = [(i, t.upper() + " $$$ ###" if i % 3 == 0 else t) for i in range(200) for t in [prose(rng, rng.randint(1, 60))]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality.fit(df, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int"), F.lit(True))
    assert rules.rules
    texts = [t for _, t in rows] + ["", None, prose(rng, 20_000)]
    x = quality.statistics(pa.array(texts))
    want = 1 / (1 + np.exp(-(rules.matrix(x) @ np.array(rules.weights) + rules.intercept)))
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want)
    t = texts[0]
    by_hand = [np.log1p(len(t.encode())), np.log1p(len(t.split())), np.mean([len(w) for w in t.split()]), sum(c.isupper() for c in t) / len(t)]
    assert np.allclose(x[0][:4], by_hand)


def test_toxicity_against_brute_force(spark):
    import zstandard

    rng = random.Random(15)
    bad = ["slurword", "vileterm", "badnoun"]
    sample = [(" ".join(rng.choice(bad) if y and rng.random() < 0.2 else w for w in prose(rng, 50, 3000).split()), y) for y in (0, 1) for _ in range(150)]
    model = toxicity.train(sample, 0.5)
    # each dictionary holds words of its own class
    assert b"slurword" in model.toxic and b"slurword" not in model.ordinary and len(model.toxic) == len(model.ordinary) and model.ordinary.count(b" w") > 100
    texts = [t for t, _ in sample[:20] + sample[-20:]] + ["", "x", "Slurword\n\tVILETERM", prose(rng, 5000)]

    def size(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters(window_log=14, hash_log=14, chain_log=14, search_log=4, min_match=5, target_length=8, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(window))

    got = toxicity.Scorer(model)(pa.array(texts))
    for t, score in zip(texts, got, strict=True):
        raw = t.translate({i: i + 32 for i in range(65, 91)}).translate(dict.fromkeys(range(9, 14), 32)).encode()
        starts = [] if not raw else [0] if len(raw) <= 48 else [min(24 * k, len(raw) - 48) for k in range(-(-(len(raw) - 48) // 24) + 1)]
        lead = model.toxic[-64:-48]
        llr = [model.odds[min(max(size(model.ordinary, lead + raw[a : a + 48]) - size(model.toxic, lead + raw[a : a + 48]), -8), 12) + 8] for a in starts]
        total = sum(llr)
        x = [np.sign(total) * np.log1p(abs(total)), total / max(1, len(llr)), max(llr, default=0), np.log1p(len(llr)), *(np.log1p(sum(v > b for v in llr)) for b in (0.5, 1.5, 2.5))]
        z = float(np.array(x) / model.scale @ model.coef[:-1] + model.coef[-1])
        assert abs(score - (1 / (1 + np.exp(-np.clip(z, -30, 30))) if raw else model.prevalence)) < 1e-9


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    bad = ["slurword", "vileterm", "badnoun"]
    clean = [words_only(rng, 80) for _ in range(60)]
    toxic = [" ".join(rng.choice(bad) if rng.random() < 0.3 else w for w in words_only(rng, 60).split()) for _ in range(60)]
    item = words_only(rng, 40)
    rows = [(i, t + ("\na footer that all of them have" if i < 20 else "")) for i, t in enumerate(clean)]
    rows += [(100 + i, t) for i, t in enumerate(toxic)] + [(200, clean[30]), (201, clean[31] + " more"), (202, clean[32] + " " + item), (203, None), (None, words_only(rng, 50))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(60), *range(100, 160)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen.append((at.columns, {r["doc_id"] for r in at.collect()}))
    assert all(c == docs.columns for c, _ in seen[:-1])
    kept = {*range(60), 203, None}
    assert len(seen[0][1] & set(range(100, 160))) <= 3
    assert (kept | {200, 201, 202}) - seen[0][1] == set()
    assert seen[2][1] >= kept and not seen[2][1] & {200, 201} and 202 not in seen[3][1] and seen[3][1] >= kept and seen[4][1] == seen[3][1]
    packed = {r["doc_id"]: r["doc_tokens"] for r in at.collect()}
    assert packed[3] == len(lib_ids(WORDS, clean[3])) + 1 and packed[203] == 1  # the footer is gone
