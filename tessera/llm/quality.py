"""Quality by a sparse rule ensemble over text statistics, compiled to Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.toxicity import fold
from tessera.llm.words import buffers, map_texts, shingles, slices, words

#: Labelled rows of each class in the training sample at most, in the order of a hash of their ids.
SAMPLE = 6000
TREES, DEPTH, BINS = 24, 3, 32

FEATURES = [
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "bang_share", "symbol_share", "bar_share", "stop_share",
    "wide_share", "distinct_share", "repeat_share", "twin_share", "longest_word", "line_length", "line_share", "end_share", "short_share",
]


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


UPPER, DIGIT, BANG, BAR = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"!"), _class(b"|")
SYMBOL, STOP, LINE = _class(b"#$%&*@^~_=+<>{}[]\\/"), _class(b".,;:?"), _class(b"\n")
WIDE = np.arange(256) >= 128


def statistics(col: pa.Array) -> np.ndarray:
    """The features of every text, whole; an empty text has zeros."""
    raw, off = buffers(col)
    w = words(col)
    size, count = np.diff(off), w.counts()
    n, m = np.maximum(1, size), np.maximum(1, count)

    def share(table):
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return (total[off[1:]] - total[off[:-1]]) / n

    def per_text(flags, bounds):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    h, of = w.hashes(), w.text_of()
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=len(size))
    s, sb = shingles(w, h, 5)
    so = np.repeat(np.arange(len(size)), np.diff(sb))
    order = np.lexsort((s, so))
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[order][1:] != s[order][:-1]) | (so[order][1:] != so[order][:-1])
    shapes = np.bincount(so[order][fresh], minlength=len(size))
    twin = np.zeros(len(h), dtype=bool)
    twin[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    length = w.end - w.start
    longest = np.zeros(len(size))
    if len(h):
        np.maximum.at(longest, of, length)
    last = raw[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    lines = share(LINE) * n + 1
    return np.stack(
        [
            np.log1p(size), np.log1p(count), per_text(length, w.bounds) / m, share(UPPER), share(DIGIT), share(BANG), share(SYMBOL), share(BAR), share(STOP),
            share(WIDE), distinct / m, 1 - shapes / np.maximum(1, np.diff(sb)), per_text(twin, w.bounds) / m, np.log1p(longest), np.log1p(size / lines), lines / m,
            per_text(SYMBOL[last] | BANG[last], w.bounds) / m, per_text(length <= 2, w.bounds) / m,
        ],
        1,
    )


Condition = tuple[int, bool, float]  # feature, over (else at most), bound


@dataclass
class Rules:
    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def score(self) -> Column:
        """The ensemble as one expression over the feature columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for k, over, bound in rule:
                c = F.col(FEATURES[k])
                test = test & (c > F.lit(float(bound)) if over else c <= F.lit(float(bound)))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.logical_and.reduce([x[:, k] > b if over else x[:, k] <= b for k, over, b in r]) for r in self.rules], 1).astype(np.float64)


def _tree(binned: np.ndarray, bounds: list[np.ndarray], g: np.ndarray, w: np.ndarray, depth: int, at: np.ndarray, path: tuple, out: list) -> np.ndarray:
    """Grow one regression tree on gradients; every node's path becomes a rule. Returns the fitted values."""
    value = np.zeros(len(g))
    total_g, total_w = g[at].sum(), w[at].sum()
    value[at] = total_g / max(total_w, 1e-9)
    if depth == 0 or len(at) < 20:
        return value
    best = (1e-9, 0, 0)
    for k in range(binned.shape[1]):
        sg = np.cumsum(np.bincount(binned[at, k], g[at], minlength=BINS))[:-1]
        sw = np.cumsum(np.bincount(binned[at, k], w[at], minlength=BINS))[:-1]
        gain = sg**2 / np.maximum(sw, 1e-9) + (total_g - sg) ** 2 / np.maximum(total_w - sw, 1e-9) - total_g**2 / max(total_w, 1e-9)
        gain[(sw < 1e-3 * w.sum()) | (total_w - sw < 1e-3 * w.sum())] = 0
        i = int(gain.argmax())
        if gain[i] > best[0] and i < len(bounds[k]):
            best = (gain[i], k, i)
    if best[1:] == (0, 0) and best[0] <= 1e-9:
        return value
    _, k, i = best
    for over in (False, True):
        side = at[(binned[at, k] > i) == over]
        rule = (*path, (k, over, float(bounds[k][i])))
        out.append(rule)
        sub = _tree(binned, bounds, g, w, depth - 1, side, rule, out)
        value[side] = sub[side]
    return value


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[Condition, ...]]:
    """Rules of boosted trees, each once, in the order grown."""
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(bounds)], 1)
    f, rules = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = _tree(binned, bounds, weight * (y - p), weight * np.maximum(p * (1 - p), 1e-3), DEPTH, np.arange(len(y)), (), rules)
        f += 0.3 * np.clip(step, -4, 4)
    return list(dict.fromkeys(rules))


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2e-4, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradients; the intercept is free."""
    z = np.hstack([z, np.ones((len(z), 1))])
    weight = weight / weight.sum()
    lip = 0.25 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + 1e-9
    b = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        new = v - (z.T @ (weight * (p - y))) / lip
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - penalty / lip)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t1 * (new - b)
        b, t = new, t1
    return b[:-1], float(b[-1])


def train(x: np.ndarray, y: np.ndarray, prevalence: float) -> Rules:
    """Trees, then rules, then their sparse weights; classes weighted to their shares among all training labels.

    With one class or none, every score is the share of label 1 (0.5 without labels).
    """
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Rules(intercept=float(np.log(share / (1 - share))))
    weight = np.where(y == 1, prevalence / (y == 1).sum(), (1 - prevalence) / (y == 0).sum()) * len(y)
    rules = Rules(grow(x, y, weight))
    b, c = lasso(rules.matrix(x), y, weight)
    keep = np.flatnonzero(np.abs(b) > 1e-6)
    return Rules([rules.rules[i] for i in keep], b[keep].tolist(), c)


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and the features, one row for each row of `docs`. A null text is an empty one."""
    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes]

    def run(batches):
        for batch in slices(batches):
            x = statistics(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=[*keep, *FEATURES])

    return map_texts(docs.select(*keep, "text"), run, ", ".join([*fields, *(f"{f} double" for f in FEATURES)]))


def fit(docs: DataFrame, labels: DataFrame, train_rows, per_class: int = SAMPLE) -> Rules:
    """Train on the statistics of up to `per_class` labelled rows of each class; only labels where `train_rows` holds are read.

    A null doc_id or label takes no part, of several labels the largest counts, repeated rows count again, and with no labels or
    one class alone the rules are empty.
    """
    rows = labels.where(train_rows).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y")).where(F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    got = np.array(sorted(tuple(r) for r in with_statistics(picked, "doc_id", "y").collect()), dtype=np.float64).reshape(-1, 2 + len(FEATURES))
    return train(got[:, 2:], got[:, 1], counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, rules: Rules, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row, repeated and null doc_ids too. A null text is an empty one, whose statistics are zeros;
    very long texts are read whole; other columns are ignored; no documents give no rows."""
    s = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("doc_id", rules.score().alias("score"))
    return s.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of `documents`, learnt from labels whose crc32(doc_id) mod 4 is not 2."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rules = fit(docs, labels, fold("doc_id", 4) != 2)
    return score(docs, rules).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
