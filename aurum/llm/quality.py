"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Inputs of a score are the text alone: its words (hashed, weighted by 1 + log count, scaled to unit length), statistics of
its structure (shares of symbols, capitals, digits, repeated words and lines, lengths; each as a one-hot of its bin among
the training texts' quantiles) and its metadata (bins of its length in characters, words and lines). The model is

    logit = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and its pairwise part is computed in time linear in the features by the sum-of-squares identity
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted on the driver with numpy on at most `most` labelled rows with at most MOST_BYTES of word slots, those with the
lowest hashes of their doc_id: that bound is the only sampling here. Scoring reads every whole text.

Defined cases: a null text is an empty one and gets a score of its own like any other; a null doc_id has held_out null and is
never fitted on; of rows that repeat a doc_id the one with the least hash of its text is fitted on; null labels are left out; where a
doc_id has several labels the largest counts; with no labelled rows, or one class only, every score is the smoothed share
of label 1; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Words, discard, ship, stored, table, worker_cache

SLOTS, FACTORS, BINS, MOST = 1 << 15, 8, 12, 12_000
#: Bytes of word slots that the driver collects for fitting at most, and slots that are scored at a time.
MOST_BYTES, CHUNK = 64 << 20, 65_536
STATISTICS = ("chars", "words", "lines", "word_length", "upper", "digit", "punctuation", "symbol", "space", "other", "distinct_words", "distinct_lines", "top_word", "no_letter_words", "shouted_words", "line_length", "end_stops", "bars", "pairs_repeated")
FEATURES = SLOTS + len(STATISTICS) * BINS

_kind = np.zeros(256, np.intp)  # other
_kind[[9, 10, 11, 12, 13, 32]] = 1
_kind[48:58] = 2
_kind[65:91] = 3
_kind[97:123] = 4
_kind[[ord(c) for c in ".,;:'\"?-()"]] = 5
_kind[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6


def word_slots() -> Words:
    """Word -> hashed slot."""
    return worker_cache("quality", lambda: Words(lambda word: xxhash.xxh32_intdigest(word) % SLOTS))


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of the words, and the statistics."""
    raw = text.encode()
    words = raw.lower().split()
    n, lines = max(1, len(raw)), raw.split(b"\n")
    kinds = np.bincount(_kind[np.frombuffer(raw, np.uint8)], minlength=7) / n
    m = max(1, len(words))
    if words:
        mapped = np.fromiter(map(word_slots().__getitem__, words), np.int64, len(words))
        slots, counts = np.unique(mapped, return_counts=True)
        values = 1 + np.log(counts)
        values = values / math.sqrt(float(values @ values))
        pairs = mapped[:-1] * SLOTS + mapped[1:]
        repeated = 1 - len(np.unique(pairs)) / max(1, len(pairs))
        top = counts.max() / m
    else:
        slots, values, repeated, top = np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0
    cased = raw.split()
    upper = sum(map(bytes.isupper, cased)) / m
    bare = sum(1 for w in cased if w.isascii() and not any(map(str.isalpha, w.decode()))) / m if kinds[2] + kinds[5] + kinds[6] > 0.05 else 0.0
    stops = sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?")) / len(lines)
    stats = (math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), sum(map(len, words)) / m, kinds[3], kinds[2], kinds[5], kinds[6], kinds[1], kinds[0], len(set(words)) / m, len(set(lines)) / len(lines), top, bare, upper, math.log1p(n / len(lines)), stops, raw.count(b"|") / n, repeated)
    return slots, values, np.asarray(stats)


def binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The one-hot slots of the statistics."""
    return SLOTS + np.arange(len(STATISTICS)) * BINS + (stats[:, None] > edges).sum(axis=1)


class Machine:
    def __init__(self, edges: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.edges, self.bias, self.linear, self.factors = edges, bias, linear, factors

    def rows(self, found):
        slots, values, stats = found
        own = binned(stats, self.edges)
        return np.concatenate([slots, own]), np.concatenate([values, np.full(len(own), 1 / math.sqrt(len(own)))])

    def scores(self, found: list) -> np.ndarray:
        """Of documents' features, all documents side by side."""
        rows = list(map(self.rows, found))
        i, x = (np.concatenate(c) for c in zip(*rows, strict=True))
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        v = self.factors[i] * x[:, None]
        z = self.bias + np.add.reduceat(self.linear[i] * x, starts) + 0.5 * (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v**2, starts)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.scores([features(text)])[0])


def fit(found: list, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.03, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adam on the logistic loss, mini-batches in an order fixed by the seed."""
    n, ones = len(labels), float(labels.sum())
    bias = math.log((ones + 1) / (n - ones + 1))
    stats = np.asarray([f[2] for f in found]).reshape(n, len(STATISTICS))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if n else np.zeros((len(STATISTICS), BINS - 1))
    rng = np.random.default_rng(seed)
    model = Machine(edges, bias, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)))
    if not 0 < ones < n:
        model.factors[:] = 0
        return model
    rows = [model.rows(f) for f in found]
    theta = np.concatenate([model.linear[:, None], model.factors], axis=1)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            some, step = order[k : k + batch], step + 1
            i = np.concatenate([rows[r][0] for r in some])
            x = np.concatenate([rows[r][1] for r in some])
            starts = np.cumsum([0, *(len(rows[r][0]) for r in some[:-1])])
            sizes = np.diff([*starts, len(i)])
            v = theta[i, 1:] * x[:, None]
            sums = np.add.reduceat(v, starts)
            z = model.bias + np.add.reduceat(theta[i, 0] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(v**2, starts)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            each = np.repeat(g, sizes) * x
            slope = np.concatenate([each[:, None], each[:, None] * (np.repeat(sums, sizes, axis=0) - v)], axis=1)
            used, where = np.unique(i, return_inverse=True)
            total = np.stack([np.bincount(where, slope[:, c], len(used)) for c in range(FACTORS + 1)], axis=1) + decay * theta[used]
            first[used] = 0.9 * first[used] + 0.1 * total
            second[used] = 0.99 * second[used] + 0.01 * total**2
            theta[used] -= rate * first[used] / (np.sqrt(second[used]) + 1e-6)
            model.bias -= 0.02 * float(g.sum())
    model.linear, model.factors = theta[:, 0].copy(), theta[:, 1:].copy()
    return model


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Machine:
    """Fit on labelled rows that are not held out: the `most` with the lowest hashes of their doc_id."""
    ship(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it can be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    # of rows that repeat a doc_id the one with the least hash of its text counts, so that the bound holds
    rows = rows.groupBy("doc_id", F.col("quality").cast("int").alias("quality")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "quality": batch.column(2), "slots": [f[0].astype("<i4").tobytes() for f in got], "word_values": [f[1].astype("<f4").tobytes() for f in got], "stats": [f[2].tobytes() for f in got]})

    got = stored(rows.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, slots binary, word_values binary, stats binary"), "features")
    sizes = got.select("doc_id", F.length("slots").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most `most` pairs of numbers
    fits = np.cumsum([r["n"] for r in sizes]) <= MOST_BYTES
    kept = {r["doc_id"] for r, f in zip(sizes, fits, strict=True) if f}
    if len(kept) < len(sizes):
        got = got.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted(kept)], "doc_id long")), "doc_id", "left_semi")
    found = sorted(got.collect(), key=lambda r: r["doc_id"])
    discard(got) if len(kept) == len(sizes) else None
    arrays = [(np.frombuffer(r["slots"], "<i4").astype(np.int64), np.frombuffer(r["word_values"], "<f4").astype(float), np.frombuffer(r["stats"])) for r in found]
    return fit(arrays, np.asarray([float(r["quality"] > 0) for r in found]))


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """All columns of docs and quality_score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        mine, out, found, held = Machine(*shared.value), [], [], 0
        for text in texts:
            found.append(features(text.as_py()))
            held += len(found[-1][0])
            if held >= CHUNK:
                out.append(mine.scores(found))
                found, held = [], 0
        if found:
            out.append(mine.scores(found))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn("quality_score", score(F.coalesce("text", F.lit(""))))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
