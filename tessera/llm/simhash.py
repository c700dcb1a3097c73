"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.components import EDGES, HELD, components, forest
from tessera.llm.words import SPACE, map_texts, mix64, shingles, slices, words

#: Fingerprints in one table's bucket up to which they are compared with each other in one task.
BUCKET = 512


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text, the bits that are set in over half of its hashes; zero without hashes."""
    n = np.diff(bounds)
    out = np.zeros(len(n), dtype=np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[:-1][has], axis=0, dtype=np.int32)
        out[has] = np.packbits(2 * ones > n[has, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def masks(bits: int, radius: int) -> list[int]:
    """Covering masks: any two words of `bits` bits that differ in at most `radius` of them agree under at least one.

    Bit i is dealt a nonzero vector of radius + 1 bits in turn; the mask of each nonzero v holds the bits whose vector
    has an odd product with v. Some v is orthogonal to the vectors of any `radius` bits.
    """
    deal = [1 + (i * 0x9E3779B1 + (i // ((1 << (radius + 1)) - 1)) * 7) % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(deal) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def xxh_fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) by XXH64 of space-joined `size`-word shingles, A-Z lower-cased. A null text is an empty one, whose fingerprint is zero."""

    def run(batches):
        import xxhash

        one = xxhash.xxh64_intdigest
        for batch in slices(batches):
            w = words(batch.column(1))
            # words joined by single blanks, so that each shingle is one span
            length = w.end - w.start
            at = np.concatenate([[0], np.cumsum(length + 1)]).astype(np.int64)
            joined = np.full(at[-1], 0x20, dtype=np.uint8)
            inside = np.ones(at[-1], dtype=bool)
            inside[at[1:] - 1] = False
            joined[inside] = w.data[~SPACE[w.data]]
            counts = w.counts()
            have = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
            bounds = np.concatenate([[0], np.cumsum(have)]).astype(np.int64)
            of = np.repeat(np.arange(len(counts)), have)
            first = w.bounds[:-1][of] + np.arange(len(of)) - bounds[:-1][of]
            last = np.minimum(first + size, w.bounds[1:][of]) - 1
            raw = joined.tobytes()
            h = np.fromiter((one(raw[a:b], seed) for a, b in zip(at[first].tolist(), (at[last] + length[last]).tolist(), strict=True)), dtype=np.uint64, count=len(of))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(h, bounds).view(np.int64))], names=["doc_id", "fp"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within `radius` bits, and only such.

    Fingerprints meet in the tables of a covering family, so none within the radius is missed. A bucket of up to
    `BUCKET` fingerprints is compared in one task, which gives a spanning forest of its links. A larger one is never
    gathered: each fingerprint gives a key for every choice of `radius` of the bits that the table leaves open, with
    those bits wiped; two are within the radius just if they share such a key, and each is linked to the smallest there.
    """
    family = masks(64, radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(family)])).alias("x")
    keys = fps.select("fp", table).select("fp", "x.t", "x.key")
    size = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(size, ["t", "key"])

    def compare(batches):
        for batch in batches:
            out = [[], []]
            for members in batch.column(0).to_pylist():
                x = np.sort(np.array(members, dtype=np.int64))
                u = x.view(np.uint64)
                i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= radius, 1))
                if len(i):
                    a, b = forest(i, j)
                    out[0].append(x[a])
                    out[1].append(x[b])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["a", "b"])

    few = met.where(F.col("n") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(compare, EDGES)

    from itertools import combinations

    def wipe(batches):
        for batch in batches:
            t, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for k, m in enumerate(family):
                own = fp[t == k]
                if not len(own):
                    continue
                free = [i for i in range(64) if not m >> i & 1]
                wiped = [_signed(((1 << 64) - 1) ^ sum(1 << i for i in c)) for c in combinations(free, radius)]
                for c, w in enumerate(wiped):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(np.full(len(own), c, np.int32)), pa.array(own & np.int64(w)), pa.array(own)], names=["t", "c", "key", "fp"])

    many = met.where(F.col("n") > BUCKET).select("t", "fp").mapInArrow(wipe, "t int, c int, key long, fp long")
    hub = many.groupBy("t", "c", "key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    return few.union(many.join(hub, ["t", "c", "key"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def near_groups(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) from (doc_id, fp): groups of fingerprints linked at `radius` or fewer bits.

    Equal fingerprints are one node. component_id is the smallest doc_id of the group (null only where all are null).
    """
    prints = store.stage(prints, "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    of = components(links(nodes.select("fp"), radius), "simhash")
    own = nodes.join(of, nodes["fp"] == of["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    own = store.stage(own, "simhash-nodes")
    roots = own.groupBy("root").agg(F.min("low").alias("component_id"))
    named = own.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of `documents`."""
    return near_groups(xxh_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: The general operator's fingerprints: so many, of so many bits, each met within so many bits. The last is a SimHash; the others are
#: bits of the sketch, of which two texts at the similarity below differ in 5 of 48 on average, and in 7 of a SimHash's.
PRINTS, BITS, RADIUS = 3, 48, 5
#: Words of a shingle, and the similarity from which two texts count as near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Hash functions of a sketch, and bins of each, of whose least hash it has a bit: 192 bits, of which two texts differ in half of (1 - similarity).
ROUNDS, BINS = 16, 12
#: Bits of the sketch up to which a pair is a candidate: at that similarity they differ in 19 on average, with a deviation of 4 to 5.
LOOSE = 31
#: Keys of two smallest hashes of a set each, by which a text first meets the smallest doc_id of its large group, and so many next ones.
LEASTS, BESIDE = 3, 3


def _sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct `SHINGLE`-word shingles of each text, and their bounds."""
    w = words(col)
    s, bounds = shingles(w, w.hashes(), SHINGLE)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[fresh], np.concatenate([[0], np.cumsum(np.bincount(of[fresh], minlength=len(bounds) - 1))]).astype(np.int64)


def sketch(s: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n x 3 words: of each text's shingle set, for each of `ROUNDS` hashes, a bit of the least one in each of `BINS` bins.

    An empty bin takes the least hash of the next one that is not; a text without shingles has zeros.
    """
    bits = np.zeros((n, ROUNDS * BINS), dtype=np.uint8)
    none = np.uint64(2**64 - 1)
    for k in range(ROUNDS):
        h = mix64(s ^ np.uint64(0x8EBC6AF09C88C6E3 * (k + 1) & (2**64 - 1)))
        least = np.full(n * BINS, none, dtype=np.uint64)
        np.minimum.at(least, of * BINS + (h % np.uint64(BINS)).astype(np.int64), h)
        least = least.reshape(n, BINS)
        for _ in range(BINS - 1):
            empty = least == none
            if not empty.any():
                break
            least = np.where(empty, np.roll(least, -1, axis=1), least)
        bits[:, k * BINS : (k + 1) * BINS] = (mix64(least + np.arange(BINS, dtype=np.uint64)) >> np.uint64(32)) & np.uint64(1)
    bits[np.bincount(of, minlength=n) == 0] = 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


E_NAMES, S_NAMES, M_NAMES = ["e0", "e1"], [f"s{k}" for k in range(ROUNDS * BINS // 64)], [f"m{k}" for k in range(LEASTS)]


def word_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, e0, e1, f0, s0.., m0..): a digest, the SimHash, the sketch, and keys of two least hashes each, of the set of `SHINGLE`-word shingles."""
    low = np.uint64((1 << BITS) - 1)
    names = [*E_NAMES, "f0", *S_NAMES, *M_NAMES]

    def run(batches):
        for batch in slices(batches, limit=1_000_000):
            s, bounds = _sets(batch.column(1))
            salted = lambda k: mix64(s ^ np.uint64(0xA0761D6478BD642F * (k + 1) & (2**64 - 1)))  # noqa: E731, B023
            some = np.diff(bounds) > 0
            cols = []
            for k in (0, 1):  # sums over the set: the same for equal sets alone, but for chance
                total = np.zeros(len(some), dtype=np.uint64)
                if some.any():
                    total[some] = np.add.reduceat(mix64(s + np.uint64(0x9E6C63D0876A9A47 * (k + 1) & (2**64 - 1))), bounds[:-1][some])
                cols.append(pa.array(total.view(np.int64)))
            cols.append(pa.array((majority(salted(0), bounds) & low).view(np.int64)))
            cols += [pa.array(x.view(np.int64)) for x in sketch(s, np.repeat(np.arange(len(some)), np.diff(bounds)), len(some)).T.copy()]
            for k in range(LEASTS):
                key = np.zeros(len(some), dtype=np.uint64)
                if some.any():
                    one, two = (np.minimum.reduceat(salted(PRINTS + 2 * k + j), bounds[:-1][some]) for j in (0, 1))
                    key[some] = mix64(one * np.uint64(0xD6E8FEB86659FD93) + two)
                cols.append(pa.array(key.view(np.int64), mask=~some))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def verified(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The edges (a, b: doc_id) whose texts' shingle sets have a similarity of at least `SIMILARITY`."""

    def collect(batches):
        for batch in slices(batches, limit=1_000_000):
            s, bounds = _sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(s.view(np.int64)))], names=["node", "own"])

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.asarray(batch.column(k)[i].values) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= SIMILARITY * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    edges = store.stage(edges.distinct(), "candidates")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    sets = store.stage(map_texts(texts, collect, "node long, own array<long>"), "candidate-sets")
    met = edges.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    out = store.stage(met.mapInArrow(compare, EDGES), "verified")
    for x in (edges, sets):
        if store.staged_path(x):
            store.discard(docs.sparkSession, store.staged_path(x))
    return out


#: Rows of a bucket compared with as many others at once.
TILE = 512
#: Rows up to which the buckets of a batch are compared together.
SMALL = 64


def runs(batches):
    """Columns of a table sorted by its first, cut so that equal values of it stay together."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns]
        held.append(cols)
        n += batch.num_rows
        # a run that goes on is only gathered
        if cols[0][-1] == held[0][0][0]:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1
        yield [c[:cut] for c in cols]
        held = [[c[cut:].copy() for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def far(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(f[i, k] ^ f[j, k]).astype(np.int16) for k in range(f.shape[1]))


def beside(batches):
    """Edges between rows (key, node, prints) and the next `BESIDE` of the same key, in the order given, that differ in at most `LOOSE` bits."""
    last: list[np.ndarray] = []
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        old = len(last[0]) if last else 0
        if last:
            cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
        key, node, f = cols[0], cols[1], np.stack(cols[2:], 1).view(np.uint64)
        out = [np.zeros((2, 0), np.int64)]
        for d in range(1, BESIDE + 1):
            j = np.arange(max(d, old), len(key))
            j = j[key[j] == key[j - d]]
            j = j[far(f, j, j - d) <= LOOSE]
            out.append(np.stack([node[j], node[j - d]]))
        a, b = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        last = [c[-BESIDE:] for c in cols]


def close(key: np.ndarray, label: np.ndarray, f: np.ndarray, most: int):
    """(i, j), i < j, of all rows of one key, but different labels, that differ in at most `most` bits; sorted by key, then label."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    end = np.repeat(first + size, size)
    i = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    d = 1
    while len(i := i[i + d < end[i]]):
        apart = i[label[i] != label[i + d]]
        near = apart[far(f, apart, apart + d) <= most]
        yield near, near + d
        d += 1
    for lo, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        for a in range(lo, lo + n, TILE):
            for b in range(a, lo + n, TILE):
                x, y = np.arange(a, min(a + TILE, lo + n)), np.arange(b, min(b + TILE, lo + n))
                if label[a] == label[y[-1]]:
                    continue
                i, j = np.nonzero((far(f, x[:, None], y[None, :]) <= most) & (label[x][:, None] != label[y][None, :]))
                i, j = i + a, j + b
                yield i[i < j], j[i < j]


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, keeper) of documents that are near copies of another, where keeper, the smallest doc_id of the group, differs.

    Two texts are near copies if their sets of `SHINGLE`-word shingles have a similarity of at least `SIMILARITY`. Candidates
    meet in the covering tables of the fingerprints (a SimHash, and two of the sketch's bits), where every pair within `RADIUS` bits of
    one collides, and differ in at most `LOOSE` bits of their sketches; each is then judged by the texts. All pairs of a bucket are
    compared but for those that are in one group already: a text is first judged against the smallest doc_id that shares two of its
    least hashes, and against the next ones that do, so that a large group doesn't give the square of its size. Texts of equal
    sets are one. Null and empty texts are equal texts, very long ones are read whole, rows without a doc_id take no
    part, and rows that repeat a doc_id are one document. No documents give no rows.
    """
    docs = docs.where("doc_id is not null")
    prints = store.stage(word_prints(docs), "prints")
    nodes = store.stage(prints.groupBy(*E_NAMES).agg(F.min("doc_id").alias("node"), *(F.min(m).alias(m) for m in ("f0", *S_NAMES, *M_NAMES))), "print-nodes")

    one = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(m).alias("m")) for k, m in enumerate(M_NAMES)])).alias("x")
    met = nodes.select("node", *S_NAMES, one).select("node", *S_NAMES, "x.k", "x.m").where("m is not null")
    hub = met.groupBy("k", "m").agg(F.min(F.struct("node", *S_NAMES)).alias("h"), F.count("*").alias("n")).where("n > 1").select("k", "m", "h")
    bits = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"h.{n}"))) for n in S_NAMES), F.lit(0))
    first = met.join(hub, ["k", "m"]).where((F.col("node") != F.col("h.node")) & (bits <= LOOSE))
    next_ones = met.select("m", "node", *S_NAMES).repartitionByRange("m", "node").sortWithinPartitions("m", "node").mapInArrow(beside, EDGES)
    sure = components(verified(first.select(F.col("node").alias("a"), F.col("h.node").alias("b")).union(next_ones), docs), "copies")
    named = nodes.join(sure, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "f0", *S_NAMES)

    family = masks(BITS, RADIUS)

    def deal(batches):
        for batch in batches:
            f = [np.asarray(batch.column(k)) & np.int64((1 << BITS) - 1) for k in (*range(3, 2 + PRINTS), 2)]  # words of the sketch, then the SimHash
            rest = [batch.column(0), batch.column(1), *batch.columns[3:]]
            for table in range(PRINTS * len(family)):
                yield pa.RecordBatch.from_arrays([pa.array(f[table // len(family)] << 8 | table), *rest], names=["at", "node", "label", *S_NAMES])

    def meet(batches):
        """Rows of a partition, sorted by table, masked fingerprint and label: all candidates of different labels, each once, in the
        first table of the first fingerprint where it meets (earlier fingerprints are words of the sketch, which the rows have)."""
        bits = np.array(family, dtype=np.int64)

        def keyed():
            for batch in batches:
                at = np.asarray(batch.column(0))
                key = (at >> 8 & bits[(at & 255) % len(family)]) << 8 | at & 255
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", *batch.schema.names])

        for key, at, node, label, *own in runs(keyed()):
            found, n = [], 0

            def put(found):
                x, y = np.unique(np.concatenate(found, axis=1), axis=1)
                return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

            for i, j in close(key, label, np.stack(own, 1).view(np.uint64), LOOSE):
                apart, table = at[i] >> 8 ^ at[j] >> 8, (at[i] & 255) % len(family)
                first = np.ones(len(i), dtype=bool)
                for k in range(PRINTS - 1):
                    before = own[k][i] ^ own[k][j]
                    first &= ((at[i] & 255) // len(family) <= k) | ~np.logical_or.reduce([before & m == 0 for m in family])
                for t, m in enumerate(family[:-1]):
                    first &= (t >= table) | (apart & m != 0)
                i, j = i[first], j[first]
                if len(i):
                    found.append(np.sort(np.stack([node[i], node[j]]), axis=0))
                    n += len(i)
                if n > HELD:
                    yield put(found)
                    found, n = [], 0
            if found:
                yield put(found)

    fields = ", ".join(f"{n} long" for n in ("at", "node", "label", *S_NAMES))
    table = F.col("at").bitwiseAND(F.lit(255))
    masked = F.shiftright("at", 8).bitwiseAND(F.element_at(F.array(*[F.lit(m) for _ in range(PRINTS) for m in family]), (table + 1).cast("int")))
    dealt = named.mapInArrow(deal, fields).repartition(F.xxhash64(table, masked)).sortWithinPartitions(table, masked, "label")
    rest = verified(dealt.mapInArrow(meet, EDGES), docs)
    of = components(rest.union(sure.select(F.col("node").alias("a"), F.col("component").alias("b"))), "copies")
    keeper = nodes.join(of, "node", "left").select(*E_NAMES, F.coalesce("component", "node").alias("keeper"))
    return prints.join(keeper, E_NAMES).where("doc_id <> keeper").select("doc_id", "keeper")


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of near copies: that of the smallest doc_id."""
    return docs.join(copies(docs).select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
