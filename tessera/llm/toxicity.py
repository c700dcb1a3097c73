"""Toxicity by compression distance: windows against zstandard dictionaries of toxic and ordinary text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import LOWER, SPACE, buffers, map_texts, shingles, slices, words

#: Bytes of a window, and from one window's start to the next.
WINDOW, STEP = 48, 24
#: Bytes before each window that both dictionaries hold.
LEAD = 16
#: Labelled documents of each class in the training sample at most, in the order of a hash of their ids.
SAMPLE = 3000
#: Bytes of each dictionary at most, so that all of it is within a window's reach; half may be marks of its class.
DICTIONARY = 3900
#: Bytes of the longest text in the training sample, which has 120 MB at most so.
SAMPLE_BYTES = 20_000
#: Bytes, with the blank before it, of the shortest beginning of a word that can speak for a class.
SHORTEST = 5
#: How much commoner in toxic texts a beginning must be to speak for them.
RATIO = 20
#: Negative logarithm of the chance that a beginning's texts are toxic so often by luck.
SURE = 10.0
#: Gains are clipped to this range, in bytes.
LEAST, MOST = -8, 12
#: Log-likelihood ratios beyond which windows are counted.
STRONG = (0.5, 1.5, 2.5)


def fold(col: str, parts: int):
    return F.crc32(F.col(col).cast("string")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train, per_class: int) -> tuple[list[tuple[str, int]], float]:
    """Texts and labels of up to `per_class` training rows of each class, and the share of label 1 in all training rows.

    Only labels where `train` holds are read. A doc_id with several labels counts with the largest, one with several texts with
    each different one. A text of over
    `SAMPLE_BYTES` is not picked, so that what reaches the driver is bounded.
    """
    rows = labels.where(train).where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y")).where(F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    got = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").collect()
    got = sorted({(r["doc_id"], r["text"], r["y"]) for r in got})
    n = sum(counts.values())
    return [(t, y) for _, t, y in got], counts.get(1, 0) / n if n else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-1, steps: int = 60) -> np.ndarray:
    """Newton's method with halved steps where the loss would grow; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * b * b).sum()

    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        while (new := loss(b - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        b, gained, now = b - step, now - new, new
        if gained < 1e-9:
            break
    return b


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    odds: np.ndarray  # log-likelihood ratio of each clipped gain
    coef: np.ndarray  # of the features; then the intercept
    scale: np.ndarray
    prevalence: float  # score of a text without windows, of which nothing is known


def _compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(
        window_log=14, hash_log=14, chain_log=14, search_log=4, min_match=5, target_length=8, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d)


class Gains:
    """Per window: compressed length with the ordinary dictionary less that with the toxic one.

    Each window follows the same `LEAD` bytes of what the dictionaries share. They compress in any case, so no frame is
    stored raw, where a match that saves a few bytes would not show. They are from before the dictionaries' last bytes,
    which the compressor doesn't index.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.lead = np.frombuffer(toxic[-4 * LEAD : -3 * LEAD].rjust(LEAD), dtype=np.uint8)

    def windows(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (offset, length) of every text, and how many each text has; a short text is one window."""
        n = np.diff(off)
        count = np.where(n == 0, 0, np.maximum(1, -(-(n - WINDOW) // STEP) + 1))
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = off[:-1][text] + np.minimum(k * STEP, np.maximum(0, n[text] - WINDOW))
        return np.stack([start, np.minimum(WINDOW, off[1:][text] - start)], 1).astype(np.uint64), count

    def __call__(self, data: np.ndarray, seg: np.ndarray) -> np.ndarray:
        import zstandard

        out = np.zeros(len(seg), dtype=np.int32)
        for i in range(0, len(seg), 20_000):
            part = seg[i : i + 20_000].astype(np.int64)
            size = part[:, 1]
            grid = np.empty((len(part), LEAD + WINDOW), dtype=np.uint8)
            grid[:, :LEAD] = self.lead
            grid[:, LEAD:] = data[np.minimum(part[:, :1] + np.arange(WINDOW), len(data) - 1)]
            at = np.stack([np.arange(len(part)) * (LEAD + WINDOW), LEAD + size], 1).astype(np.uint64)
            buf = zstandard.BufferWithSegments(grid.tobytes(), at.tobytes())
            for sign, c in ((1, self.ordinary), (-1, self.toxic)):
                out[i : i + len(part)] += sign * np.fromiter(map(len, c.multi_compress_to_buffer(buf, threads=1)), dtype=np.int32, count=len(part))
        return out


def clipped(gain: np.ndarray) -> np.ndarray:
    return np.clip(gain, LEAST, MOST) - LEAST


def features(gain: np.ndarray, count: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Per text, of its windows' log-likelihood ratios: their sum, their mean, the largest; log(1 + windows); and log(1 +
    the windows beyond each of `STRONG`)."""
    llr = odds[clipped(gain)]
    text = np.repeat(np.arange(len(count)), count)
    total = np.bincount(text, llr, minlength=len(count))
    most = np.zeros(len(count))
    has = count > 0
    if has.any():
        most[has] = np.maximum.reduceat(llr, (np.cumsum(count) - count)[has])
    strong = [np.log1p(np.bincount(text, llr > x, minlength=len(count))) for x in STRONG]
    return np.stack([np.sign(total) * np.log1p(np.abs(total)), total / np.maximum(1, count), most, np.log1p(count), *strong], 1)


def collapsed(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without near copies, whose shared words would look like marks of their class."""
    seen: set = set()
    out = []
    for t, y in sample:
        w = words(pa.array([t]))
        s, _ = shingles(w, w.hashes(), 5)
        if len(s):
            other = s * np.uint64(0x9E3779B97F4A7C15)
            marks = {("a", int(s.min())), ("b", int(s.max())), ("c", int(other.min())), ("d", int(other.max()))}
            if marks & seen:
                continue
            seen |= marks
        out.append((t, y))
    return out


def _words(text: str) -> set[bytes]:
    """Distinct words of fewer bytes than a window, each with a blank before it."""
    w = words(pa.array([text]))
    raw = w.data.tobytes()
    return {b" " + raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True) if b - a < WINDOW}


def _starts(word: bytes) -> list[bytes]:
    """The word and its beginnings that a match can have."""
    return [word[:n] for n in range(min(SHORTEST, len(word)), len(word) + 1)]


def _tally(texts: list[set[bytes]], keep: set[bytes] | None = None) -> dict[bytes, int]:
    """How many texts hold a word with each beginning, or with each of those in `keep`."""
    known: dict[bytes, list[bytes]] = {}
    out: dict[bytes, int] = {}
    for t in texts:
        found: set[bytes] = set()
        for w in t:
            if w not in known:
                known[w] = [x for x in _starts(w) if keep is None or x in keep]
            found.update(known[w])
        for x in found:
            out[x] = out.get(x, 0) + 1
    return out


def _by_count(texts: list[set[bytes]]) -> list[bytes]:
    """Words, those of most texts first."""
    tally: dict[bytes, int] = {}
    for t in texts:
        for w in t:
            tally[w] = tally.get(w, 0) + 1
    return sorted(tally, key=lambda w: (-tally[w], w))


def _content(ranked: list[bytes], size: int) -> bytes:
    """Words or beginnings as dictionary content of at most `size` bytes, the first at the end, where matches are cheapest."""
    out, held = [], 1
    for w in ranked:
        if held + len(w) > size:
            break
        out.append(w)
        held += len(w)
    return b"".join(reversed(out)) + b" "


def _marks(ordinary: list[set[bytes]], toxic: list[set[bytes]]) -> list[bytes]:
    """Beginnings of words that speak for toxic text, the surest first and none that begins another.

    Those speak whose texts are toxic so often that chance would not do it, by the Chernoff bound `SURE`. A beginning
    that several words share counts the texts of all of them; of equally sure ones the longest is taken.
    """
    q = len(toxic) / max(1, len(toxic) + len(ordinary))
    least = SURE / max(1e-9, -np.log(max(q, 1e-9)))
    held = {x: b for x, b in _tally(toxic).items() if b > least}
    other = _tally(ordinary, set(held))
    sure = {}
    for x, b in held.items():
        n = b + other.get(x, 0)
        r = b / n
        if r > q and b * (1 - q) > RATIO * q * (n - b):
            s = n * (r * np.log(r / q) + (1 - r) * np.log(max(1 - r, 1e-12) / max(1 - q, 1e-12)))
            if s > SURE:
                sure[x] = s
    taken: list[bytes] = []
    covered: set[bytes] = set()
    for x in sorted(sure, key=lambda x: (-sure[x], -len(x), x)):
        mine = _starts(x)
        if x not in covered and not covered.intersection(mine):
            taken.append(x)
            covered.add(x)
            # neither what begins this one nor what it begins
            covered.update(y for y in sure if y.startswith(x))
            covered.update(y for y in mine if y in sure)
    return taken


def dictionaries(sample: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary, of the same size, each from texts of its class.

    Either holds words of the class's texts, the commonest nearest to the end, where matches are cheapest. The classes share
    most of them, and the shared ones are in the same places, so that they compress alike. The toxic dictionary begins with
    the beginnings of words that mark toxic text (`_marks`), and the ordinary one with as many bytes of further words of
    ordinary text, the next commonest ones.
    """
    lone = collapsed(sample)
    plain, marked = ([_words(t) for t, y in lone if y == k] for k in (0, 1))
    marks = tuple(_marks(plain, marked))
    own = _content(list(marks), DICTIONARY // 2)
    ordinary = [w for w in _by_count(plain) if not w.startswith(marks)]
    shared = _content(ordinary, DICTIONARY - len(own))
    further = _content(ordinary[shared.count(b" ") - 1 :], len(own))
    size = max(len(own), len(further))
    return own.rjust(size) + shared, further.rjust(size) + shared


def train(sample: list[tuple[str, int]], prevalence: float) -> Model | None:
    """Fit dictionaries and calibration; None unless both classes have rows.

    The likelihood ratio of each gain and the calibration come from two folds, each measured with dictionaries of the
    other, each class weighted to its share among all training labels; the model's dictionaries come from both.
    """
    folds = [sample[0::2], sample[1::2]]
    if {y for _, y in sample} != {0, 1}:
        return None
    if any({y for _, y in f} != {0, 1} for f in folds):
        folds = [sample, sample]
    held, counts, ys = [], [], []
    for k in (0, 1):
        gains = Gains(*dictionaries(folds[1 - k]))
        for t, y in folds[k]:
            data, off = lowered(pa.array([t]))
            seg, count = gains.windows(off)
            held.append(gains(data, seg))
            counts.append(count)
            ys.append(y)
    gain, count, y = np.concatenate(held), np.concatenate(counts), np.array(ys)
    of = np.repeat(y, count)
    hist = [np.bincount(clipped(gain[of == k]), minlength=MOST - LEAST + 1) + 0.5 for k in (0, 1)]
    odds = np.log(hist[1] / hist[1].sum()) - np.log(hist[0] / hist[0].sum())
    x = features(gain, count, odds)
    scale = np.maximum(x.std(0), 1e-6)
    weight = np.where(y == 1, max(prevalence, 1e-3) / max(1, (y == 1).sum()), (1 - prevalence) / max(1, (y == 0).sum())) * len(y)
    return Model(*dictionaries(sample), odds, fit_logistic(x / scale, y, weight), scale, float(prevalence))


def lowered(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = buffers(col)
    data = LOWER[raw]
    data[SPACE[data]] = 0x20
    return data, off


class Scorer:
    def __init__(self, model: Model | None):
        self.model = model
        self.gains = Gains(model.toxic, model.ordinary) if model else None

    def __call__(self, col: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(col))
        data, off = lowered(col)
        seg, count = self.gains.windows(off)
        x = features(self.gains(data, seg), count, self.model.odds) / self.model.scale
        p = 1 / (1 + np.exp(-np.clip(x @ self.model.coef[:-1] + self.model.coef[-1], -30, 30)))
        return np.where(count > 0, p, self.model.prevalence)


_scorers: dict[int, Scorer] = {}


def scorer(model: Model | None) -> Scorer:
    key = hash((model.toxic, model.ordinary, model.odds.tobytes(), model.coef.tobytes())) if model else 0
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def fit(docs: DataFrame, labels: DataFrame, train_rows, per_class: int = SAMPLE) -> Model | None:
    """Train on up to `per_class` labelled documents of each class among the labels where `train_rows` holds."""
    return train(*labelled_sample(docs, labels, "toxic", train_rows, per_class))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row, in place, repeated and null doc_ids too. A null text is an empty one, which
    scores the share of label 1 in training; very long texts are read whole; other columns are ignored; without a model all score 0; no documents give no rows."""

    def run(batches):
        s = scorer(model)
        for batch in slices(batches):
            p = s(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, that score under the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        s = scorer(model)
        for batch in slices(batches):
            yield batch.filter(pa.array(s(batch.column(at)) < threshold))

    return map_texts(docs, run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of `documents`, learnt from labels whose crc32(doc_id) mod 3 is not 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, fold("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
