"""Centroid clustering, byte-level BPE and spelling variants against brute force, with nulls, ties, repeats and empty tables."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import byte_bpe, centroids, spelling
from tessera.llm.tokens import BYTE_SPLIT, default_path

RANKS = "byte_bpe_50k.tiktoken"


# -- centroids ------------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dim, scale):
    """Plain k-means in Python integers."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    return Counter((i, *reversed(near(v))) for i, v in kept), centres


@pytest.mark.parametrize("spread", [2, 40])
def test_clusters_equal_brute_force(spark, spread):
    rng = random.Random(spread)
    rows = [(i, [rng.randint(-spread, spread) / 4 for _ in range(4)]) for i in range(400)]  # small integers: many ties and equal vectors
    rows += [(5, rows[5][1]), (5, [0.0] * 4), (None, [0.25] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    out, centres = centroids.cluster(df, 16, 3, 4)
    got = out.collect()
    want, final = lloyd(rows, 16, 3, 4, 64)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    assert centres.tolist() == final


def test_bounds_skip_distances_and_keep_the_result(spark):
    rng = np.random.default_rng(2)
    heart = rng.normal(0, 8, (16, 8))
    x = (heart[rng.integers(0, 16, 2000)] + rng.normal(0, 0.5, (2000, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out, _ = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 16, 3, 8)
    got = out.collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == lloyd(rows, 16, 3, 8, 64)[0]
    assert sum(r["computed"] for r in got) < 0.5 * 2000 * 16 * 4


def test_bounds_hold_and_ties_are_not_pruned():
    rng = np.random.default_rng(5)
    for _ in range(30):
        v = rng.integers(-3, 4, (200, 3)).astype(np.int32)
        before, after = rng.integers(-3, 4, (6, 3)), rng.integers(-3, 4, (6, 3))
        after[5] = after[0]
        owner, upper, lower, _ = centroids.assign(v, np.zeros(200, np.int32), np.full(200, np.inf, np.float32), np.zeros((200, 6), np.float32), before)
        assert owner.tolist() == [int(np.argmin([centroids.squared(x[None], c)[0] for c in before])) for x in v]
        upper, lower = centroids.moved(upper, lower, owner, before, after)
        true = np.stack([np.sqrt(centroids.squared(v, c)) for c in after], 1)
        assert (upper >= true[np.arange(200), owner]).all() and (lower <= true).all()
        owner = centroids.assign(v, owner, upper, lower, after)[0]
        assert owner.tolist() == [int(np.argmin([centroids.squared(x[None], c)[0] for c in after])) for x in v]


def test_few_no_and_large_vectors(spark):
    one = spark.createDataFrame([(1, [0.5, -0.5])], "vec_id long, embedding array<double>")
    out, centres = centroids.cluster(one, 16, 3, 2)
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 1)] and centres.tolist() == [[32, -32]]
    assert centroids.cluster(one.where("false"), 16, 3, 2)[0].collect() == []
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 2, 1, 2)


def test_query_of_centroids_has_its_columns(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"file://{tmp_path}/embeddings.parquet").collect()]
    want, final = lloyd(rows, 16, 3, 64, 64)
    by = Counter()
    for (_, j, d), n in want.items():
        by[j] += d * n
    got = centroids.op11_centroids(spark, f"file://{tmp_path}")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, j, d, by[j], sum(by.values()), digest[j]) for i, j, d in want)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


# -- byte-level BPE -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(default_path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(8)
    signs = "abcdeéßñ  \t\n\r\x0b\x1c\x85  　'stred0129٣½²—…日本語ひらがな😀👩‍🔬́﻿İı!?#<|>"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    return [*out, "", "<|endoftext|>", "don't I'll WE'RE x's", "a" * 3000, "ab" * 2000, " " * 999, "\n" * 40, "é" * 700, "=" * 129, "hello  world   ", "tokenization antidisestablishmentarianism"]


def test_ids_equal_the_library(library):
    coder = byte_bpe.ranks(default_path(RANKS), BYTE_SPLIT)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(odd_texts())] == [library.encode_ordinary(t) for t in odd_texts()]
    for text in odd_texts():
        ids = coder.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_merges_of_a_small_file_are_leftmost_and_least(tmp_path):
    """Against merging by rescans, for a file whose tokens overlap in many ways."""
    rng = random.Random(4)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 400:
        new = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6)))
        if new not in tokens:
            tokens.append(new)
        if len(set(tokens)) >= 256 + 100:
            break
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    rank = {t: i for i, t in enumerate(tokens)}
    coder = byte_bpe.Ranks(str(path), r"\S+|\s+")
    for n in range(1, 70):
        raw = bytes(rng.choice(b"ab") for _ in range(n))
        parts = [bytes([b]) for b in raw]
        if raw in rank:
            parts = [raw]
        while len(parts) > 1:
            best = min((rank.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 10**9:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        want = [rank[p] for p in parts]
        assert coder.merge(raw) == want
        for width in byte_bpe.WIDTHS:
            if raw not in rank and 2 <= n <= width:
                assert np.frombuffer(coder.merge_many([raw, b"ba" * 4 + b"!"[: width - 8], raw], width)[2], "<u4").tolist() == want


def test_long_runs_take_logarithmic_merges(library):
    text = "".join(random.Random(6).choice("abcdefgh") for _ in range(100_000))
    began = time.process_time()
    ids = byte_bpe.Ranks(default_path(RANKS), BYTE_SPLIT).encode([text])[0]
    assert time.process_time() - began < 20
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_rows_of_every_kind_keep_their_place(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    rows = [(1, "Hello world", "a"), (1, "Hello world", "a"), (None, "x", None), (3, None, ""), (4, "", ""), (5, "long " * 50_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = default_path(RANKS)
    got = byte_bpe.decode(byte_bpe.encode(df, path), path).collect()
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["raw"])) for r in got) == Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert byte_bpe.encode(df.where("false"), path).collect() == []


def test_query_of_bpe_digests(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(odd_texts()[-40:])] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = byte_bpe.op12_byte_bpe(spark, f"file://{tmp_path}").collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(tuple(r) for r in got) == Counter(want)


# -- spelling -------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) == 1:
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1


def brute(counts, times=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_variants_equal_brute_force(spark, bucket):
    rng = random.Random(bucket)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(350)} | {"\U0001f600aaab", "aaab", "x" * 3000, "x" * 3001, "x" * 2999 + "y"}
    counts = {w: rng.choice([5, 5, 6, 25, 30, 125, 126, 700, 3500]) for w in words}
    df = spark.createDataFrame([(w, n, None) for w, n in counts.items()], "word string, n long, root string").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, bucket=bucket).collect()}
    assert got == brute(counts)
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(df.drop("root"), bucket).collect()]
    assert len(pairs) == len(set(pairs)) == sum(x[3] for x in got.values()) // 2


def test_a_crowded_key_is_split(spark):
    """Every word shares its first half with 1,999 others: keys of the first level hold all of them, of the last only few."""
    words = [f"common{chr(97 + i // 400)}{chr(97 + i // 20 % 20)}{chr(97 + i % 20)}xyz" for i in range(2000)]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(df, 16).collect()}
    assert got == {(a, b) for i, a in enumerate(sorted(words)) for b in sorted(words)[i + 1 :] if one_edit(a, b)}


def test_counts_of_damaged_words(spark):
    rng = random.Random(3)
    rows = [(i % 7 if i % 5 else None, " ".join(rng.choice(["Wörter", "ÀCCENT", "straße", "abcdef", "ABCDEFG", "fünf×zehn", "kurz", "don't", "naïve2times"]) for _ in range(60))) for i in range(300)]
    rows += [(1, None), (2, ""), (3, "Abcdef" * 40_000)] + [(4, "tiny tiny")] * 3
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    assert {r["word"]: r["n"] for r in spelling.count_words(df).collect()} == want
    assert spelling.variants(spelling.count_words(df.where("false"))).collect() == []


def test_chains_lead_to_their_root(spark):
    counts = {"abcdefgh": 5**9, "abcdefgx": 5**7, "abcdefyx": 5**6, "abcdezyx": 5**4, "abcdwzyx": 5**3, "abcvwzyx": 5**2, "abuvwzyx": 5}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["word"]: r["root"] for r in got} == dict.fromkeys(counts, "abcdefgh")
    with pytest.raises(ValueError, match="circle"):
        spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), times=1)
