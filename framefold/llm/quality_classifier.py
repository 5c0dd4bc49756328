"""A factorisation machine over hashed words, structure and metadata.

A document's features are its words, hashed to BUCKETS (counts scaled to a
vector of length 1), and structure statistics of the text with its length as
metadata, each cut at fixed points into one of a few indicator features. The
score is a logistic of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the
pair sum is taken in linear time as half of |sum v_i x_i|^2 - sum |v_i x_i|^2.

Weights are fitted in numpy on at most TRAIN_ROWS labelled documents, those
with the least hash of their id, a documented bound; every document is scored
whole. Label, language, source and id are never features.

Defined cases: null and wordless texts have structure features only and a
score all the same; rows with a null label or id train nothing; of several
labels of an id the highest counts; repeated rows are scored alike; extra
columns are ignored; with no labels every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, mix, slices, words_of

BUCKETS, RANK = 1 << 16, 8
TRAIN_ROWS = 1 << 13
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.05, 1e-5
FOLDS, HELD, THRESHOLD = 5, 0, 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Statistics, each with the points that part its values.
CUTS = {
    "words": [1, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000],
    "bytes": [1, 50, 100, 300, 1000, 3000, 10000, 30000],
    "word_length": [2, 3, 4, 4.5, 4.75, 5, 5.25, 5.5, 5.75, 6, 6.5, 7, 8, 10],
    "symbols": [0.001, 0.01, 0.05, 0.1, 0.3, 0.6, 1, 2, 3],
    "capitals": [0.002, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4, 0.6],
    "exclamations": [0.001, 0.01, 0.05, 0.2, 0.5, 1, 2],
    "digits": [0.001, 0.01, 0.03, 0.1, 0.3],
    "line_words": [1, 2, 4, 8, 16, 32, 64, 128],
    "repeated_words": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeated_pairs": [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "repeated_lines": [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "same_neighbours": [0.005, 0.01, 0.02, 0.05, 0.1, 0.3, 0.6],
}
OFFSETS = np.cumsum([0, *[len(c) + 1 for c in CUTS.values()]])
FEATURES = BUCKETS + int(OFFSETS[-1])


def distinct_in(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner's values: owner, value and count of the distinct ones in order, and how many each owner has."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])) if len(o) else np.zeros(0, np.int64)
    return o[at], v[at], np.diff(np.append(at, len(o))), np.bincount(o[at], minlength=n)


def statistics(raw: np.ndarray, offsets: np.ndarray, words: Words, hashes: np.ndarray, kinds: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    owner, count = words.text_of(), words.counts
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    within = lambda mask: np.diff(upto(mask)[offsets])
    words_, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    same = np.zeros(n)
    pairs = np.zeros(0, np.uint64)
    pair_owner = owner[:0]
    if len(hashes) > 1:
        inside = owner[1:] == owner[:-1]
        same = np.bincount(owner[1:][inside & (hashes[1:] == hashes[:-1])], minlength=n)
        pairs, pair_owner = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[inside], owner[1:][inside]
    n_pairs = distinct_in(pair_owner, pairs, n)[3]
    # Lines by the words in them: a line break is where the number of breaks before a word changes.
    breaks = upto(raw == 10)[words.starts]
    new = np.ones(len(words), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    lines = np.bincount(owner[begin], minlength=n)
    place = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words)))) if len(words) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin) if len(begin) else hashes[:0]
    n_lines = distinct_in(owner[begin], line_hash, n)[3]
    length = np.bincount(owner, weights=words.ends - words.starts, minlength=n)
    return {
        "words": count, "bytes": np.diff(offsets), "word_length": length / words_, "symbols": within(SYMBOLS[raw]) / words_,
        "capitals": within((raw >= 65) & (raw <= 90)) / size, "exclamations": within(raw == 33) / words_, "digits": within((raw >= 48) & (raw <= 57)) / size,
        "line_words": count / np.maximum(lines, 1), "repeated_words": 1 - kinds / words_, "repeated_pairs": 1 - n_pairs / np.maximum(count - 1, 1) * (count > 1) - (count <= 1),
        "repeated_lines": 1 - n_lines / np.maximum(lines, 1), "same_neighbours": same / words_,
    }


def features_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' features one after another: bounds, indices and values."""
    n = len(offsets) - 1
    words = words_of(raw, offsets)
    hashes = words.hashes()
    owner, bucket, count, kinds = distinct_in(words.text_of(), hashes & np.uint64(BUCKETS - 1), n)
    norm = np.sqrt(np.bincount(owner, weights=count.astype(float) ** 2, minlength=n))
    stats = statistics(raw, offsets, words, hashes, kinds)
    fixed = np.stack([BUCKETS + OFFSETS[k] + np.digitize(stats[name], cuts) for k, (name, cuts) in enumerate(CUTS.items())], axis=1)
    each = kinds + fixed.shape[1]
    bounds = np.concatenate([[0], np.cumsum(each)])
    index, value = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
    at = (bounds[1:, None] - fixed.shape[1]) + np.arange(fixed.shape[1])
    index[at], value[at] = fixed, 1 / np.sqrt(fixed.shape[1])
    is_word = np.ones(bounds[-1], bool)
    is_word[at] = False
    index[is_word], value[is_word] = bucket.astype(np.int32), (count / norm[owner]).astype(np.float32)
    return bounds, index, value


class Machine:
    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.bias, self.weights = np.float32(0), np.zeros(FEATURES, np.float32)
        self.factors = rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32)

    def raw(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic, each row's sum of v_i x_i, and the v_i x_i. No row is without features."""
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, bounds[:-1], axis=0)
        square = np.add.reduceat((vx * vx).sum(axis=1), bounds[:-1])
        linear = np.add.reduceat(self.weights[index] * value, bounds[:-1])
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - square), total, vx

    def score(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(bounds, index, value)[0].astype(float), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 13) -> None:
        """Adagrad on the log loss, in batches."""
        rng = np.random.default_rng(seed)
        g_bias, g_weights, g_factors = np.float32(1e-6), np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32)
        for _ in range(EPOCHS if len(rows) else 0):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                own = order[at : at + BATCH]
                index, value = np.concatenate([rows[k][0] for k in own]), np.concatenate([rows[k][1] for k in own])
                each = np.array([len(rows[k][0]) for k in own])
                bounds = np.concatenate([[0], np.cumsum(each)])
                raw, total, vx = self.raw(bounds, index, value)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]).astype(np.float32) / len(own)
                per, used = np.repeat(error, each), np.unique(index)
                at_used = np.searchsorted(used, index)
                gw = np.bincount(at_used, weights=per * value, minlength=len(used)).astype(np.float32) + DECAY * self.weights[used]
                slope = per[:, None] * value[:, None] * (np.repeat(total, each, axis=0) - vx)
                gv = np.stack([np.bincount(at_used, weights=slope[:, f], minlength=len(used)) for f in range(RANK)], axis=1).astype(np.float32) + DECAY * self.factors[used]
                gb = error.sum()
                g_bias += gb * gb
                g_weights[used] += gw * gw
                g_factors[used] += gv * gv
                self.bias -= np.float32(RATE * gb / np.sqrt(g_bias))
                self.weights[used] -= RATE * gw / np.sqrt(g_weights[used])
                self.factors[used] -= RATE * gv / np.sqrt(g_factors[used])


def held_out(folds: int = FOLDS, held: int = HELD) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most rows labelled documents outside the held-out fold; of an id with several texts the least counts."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most TRAIN_ROWS pairs of numbers: safe to broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column("text")):
                bounds, index, value = features_of(data, offsets)
                cut = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), batch.column("label").slice(at, to - at), pa.ListArray.from_arrays(cut, pa.array(index)), pa.ListArray.from_arrays(cut, pa.array(value))], names=["doc_id", "label", "index", "value"])

    schema = sample.select("doc_id", "label", F.expr("cast(array() as array<int>)").alias("index"), F.expr("cast(array() as array<float>)").alias("value")).schema
    found = sample.mapInArrow(run, schema).toArrow().sort_by("doc_id").combine_chunks()  # TRAIN_ROWS rows at most
    machine = Machine()
    if len(found):
        lists = [found.column(c).combine_chunks() for c in ("index", "value")]
        machine.fit([(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(*lists)], found.column("label").to_numpy())
    else:
        machine.factors[:] = 0
    return machine


def classified(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # FEATURES * (RANK + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column("text")):
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(shared.value.score(*features_of(data, offsets)))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
