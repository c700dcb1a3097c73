"""Spelling variants: words of one edit found by an even-partition pigeonhole join, and each one's more frequent form."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.words import slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Index rows under one key from which the key is split by the next level of segments.
BUCKET = 64


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, damaged: int | None = 199) -> DataFrame:
    """(word, n): runs `[A-Za-z\\u00C0-\\u00FF]+`, A-Z lower-cased, of at least so many code points and occurrences.

    With `damaged`, a run whose crc32 of `<doc_id>:<run>` it divides loses the code point at that crc32 modulo its length first.
    A null text has no runs; a null doc_id is written `null`. Tasks hand on counts of distinct words.
    """

    def run(batches):
        held: Counter = Counter()

        def put():
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = b"null:" if i is None else f"{i}:".encode()
                for word, n in Counter(RUN.findall(lowered(text or ""))).items():
                    if damaged:
                        h = zlib.crc32(mark + word.encode())
                        if h % damaged == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
            if len(held) >= HELD:
                yield put()
        if held:
            yield put()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row's region of the word in two: the edit lies in the one, so the other one is equal in both words.

    A row stands for a word in which, but for the region of `span` + `extra` code points from `at` on, all is equal to an indexed
    word of `size` code points whose own region has `span`. The half that joins the equal part is a segment of the even partition.
    """
    h = F.floor(F.col("span") / 2).cast("int")
    regions = F.array(F.struct((F.col("at") + h).alias("at"), (F.col("span") - h).alias("span")), F.struct(F.col("at").alias("at"), h.alias("span")))
    out = rows.withColumn("r", F.explode(regions)).select("word", "n", "size", "extra", "r.at", "r.span")
    return out.withColumn("key", _key())


def _key() -> Column:
    """Digest of the indexed length, the region's place, and the text before and after it."""
    rest = F.col("at") + F.col("span") + F.col("extra")
    return F.xxhash64("size", "at", "span", F.expr("substring(word, 1, at)"), F.substring("word", rest + 1, F.length("word")))


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, n_a, b, n_b), once for each two distinct words of `words` (word, n) that differ by exactly one inserted, deleted or replaced code point.

    Each word is indexed under its two segments, half of its code points each; it probes, as a word of equal length, the same
    places, and, as a word one longer, the first segment at its place and the second one place on. Two words of one edit share a
    segment. Under a key of more than `bucket` indexed words the part beyond the segment is halved again, in which the same holds,
    and so on; at last only words that differ at one place share a key, so that no key's rows grow with the table.
    Candidates that meet under several keys count once; one edit is verified on the words. Null words are left out.
    """
    words = words.where("word is not null")
    size = F.length("word").cast("int")
    own = words.select("word", "n", size.alias("size"), F.lit(0).alias("extra"), F.lit(0).alias("at"), size.alias("span"))
    longer = words.select("word", "n", (size - 1).alias("size"), F.lit(1).alias("extra"), F.lit(0).alias("at"), (size - 1).alias("span"))
    index, probes, out = _halved(own), _halved(own.unionByName(longer)), None
    while True:
        hot = store.stage(index.groupBy("key").agg(F.count("*").alias("c"), F.max("span").alias("span")).where((F.col("c") > bucket) & (F.col("span") > 1)).select("key"), "spelling-keys")
        i, p = (x.join(hot, "key", "left_anti").alias(a) for x, a in ((index, "i"), (probes, "p")))
        fits = (F.col("p.extra") == 1) | (F.col("i.word") < F.col("p.word"))
        one = F.levenshtein(F.col("i.word"), F.col("p.word"), 1) == 1
        met = i.join(p, (F.col("i.key") == F.col("p.key")) & (F.col("i.size") == F.col("p.size")) & fits & one)
        met = met.select(F.col("i.word").alias("a"), F.col("i.n").alias("n_a"), F.col("p.word").alias("b"), F.col("p.n").alias("n_b"))
        out = met if out is None else out.union(met)
        if hot.isEmpty():
            return out.distinct()
        index, probes = (store.stage(_halved(x.join(hot, "key", "left_semi")), "spelling-" + a) for x, a in ((index, "index"), (probes, "probes")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms` (word, form): the last word that forms lead to, by doubling; forms never lead in a circle."""
    now = store.stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        a, b = now.alias("a"), now.alias("b")
        step = a.join(b, F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("on"))
        step = store.stage(step, "spelling-roots")
        if step.where("on").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(words: DataFrame, times: int = 5, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `words` (word, n; each word once).

    A word's form is its near word of the largest n (ties: the smallest in code-point order) if that is at least `times` the word's
    own, else null; its root is the last word that forms lead to, itself if it has none. `times` must be over 1. An empty table
    gives none; other columns are ignored.
    """
    if times <= 1:
        raise ValueError("times must be over 1: forms could lead in a circle")
    words = store.stage(words.select("word", "n"), "spelling-words")
    pairs = near_words(words, bucket)
    each = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n"))))
    near = pairs.select(each.alias("x")).groupBy("x.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.n")).alias("n"), F.col("x.other").alias("other"))).alias("best"))
    most = -F.col("best.n")
    fits = most >= F.col("n") * times
    got = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, most).alias("form_n"))
    got = store.stage(got, "spelling-forms")
    roots = _roots(got.where("form is not null"))
    return got.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all `documents`."""
    return variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
