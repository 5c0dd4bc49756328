"""A log-bilinear language model trained by noise-contrastive estimation.

Outputs are the OUTPUTS most frequent tokens and, for all other words, a class
by their last two bytes: the CLASSES most frequent endings and one for the
rest. A score is bilinear, s(w | c) = r_w . C q_c + b_w, with c the output of
the token before (or the start of the text). A word of a class then has the
class's probability times (n + 1) / (N + V + 1), n being its count in training
and N, V the class's tokens and distinct words, which leaves room for one
unknown word in each class: all probabilities add up to 1.

Every training token counts: word counts and the counts of neighbouring
outputs are gathered over the whole corpus, summed in each task before they
are shuffled. The neighbour counts, (OUTPUTS + CLASSES + 2)**2 cells at most,
are what training needs, so NCE takes the expectation over noise exactly
instead of drawing it. One batched matrix product then gives all normalised
log-probabilities, a table of bounded size that scoring looks up.

Counts of the most frequent words, DICTIONARY at most, travel with that table;
rarer words are joined with the table of counts by hash.

Defined cases: null text is empty and has the end token alone; a null id
counts as the empty text for the split; equal rows are each scored and each
train; words are equal if their 64-bit hashes are; extra columns are ignored;
with no training text every token is unknown and scores follow the uniform
table; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .text import Words, slices, words_of

OUTPUTS, CLASSES, DICTIONARY = 1024, 255, 1 << 17
SIZE, NOISE, STEPS, RATE = 32, 10, 150, 0.05
FOLDS, HELD = 7, 2
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 1 << 20
END = 0


def held_out(folds: int = FOLDS, held: int = HELD) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held


def endings(words: Words) -> np.ndarray:
    """The last two bytes of each word as one number; of a one-byte word, the one."""
    last = words.data[words.ends - 1].astype(np.int32)
    before = words.data[np.maximum(words.ends - 2, 0)].astype(np.int32)
    return last + 256 * np.where(words.ends - words.starts > 1, before, 0)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys; the first value summed, others taken from one row of the key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(values[0][order], at) if len(at) else values[0][:0]
    return keys[at], sums, *[v[order][at] for v in values[1:]]


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n, ending of each distinct word of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            return summed(*(np.concatenate(x) for x in zip(*parts)))

        def out(h: np.ndarray, n: np.ndarray, ending: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(ending)], names=["h", "n", "ending"])

        size = 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                words = words_of(data, offsets)
                parts.append(summed(words.hashes(), np.ones(len(words), np.int64), endings(words)))
                size += len(parts[-1][0])
                if size > 2 * HELD_WORDS:
                    parts = [merged()]
                    size = len(parts[0][0])
                    if size > HELD_WORDS:
                        yield out(*parts[0])
                        parts, size = [], 0
        if parts:
            yield out(*merged())

    return docs.select("text").mapInArrow(run, "h long, n long, ending int").groupBy("h").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))


@dataclass
class Vocabulary:
    """The dictionary (sorted hashes, counts, outputs), the class of each ending, and the classes' tokens and words."""

    hashes: np.ndarray
    counts: np.ndarray
    outputs: np.ndarray
    class_of: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int
    ends: int

    @property
    def size(self) -> int:
        """Outputs: END, frequent words, classes."""
        return len(self.class_tokens)

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's output, and its count, -1 if it is not in the dictionary."""
        h = words.hashes()
        out = self.class_of[endings(words)]
        count = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            out = np.where(known, self.outputs[at], out)
            count[known] = self.counts[at[known]]
        return out, count


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # How many words have about how many tokens: a few ten thousand rows at most, and no sort of all words.
    width = "greatest(length(bin(n)) - 10, 0)"
    many = sorted(counts.groupBy(F.expr(f"shiftleft(shiftright(n, {width}), {width})").alias("least")).count().collect(), reverse=True)
    fit = np.cumsum([r["count"] for r in many]) <= DICTIONARY
    # If the first step alone is too large, its words of the least hashes make up the dictionary.
    least = many[max(int(fit.sum()), 1) - 1]["least"] if many else None
    chosen = counts.filter(F.col("n") >= F.lit(least).cast("long"))
    top = (chosen if not many or fit[0] else chosen.orderBy("h").limit(DICTIONARY)).toArrow().sort_by([("n", "descending"), ("h", "ascending")])  # DICTIONARY rows at most
    by_ending = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()  # 65,536 rows at most
    h, n, ending = (top.column(c).to_numpy() for c in ("h", "n", "ending"))
    tokens, types = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at = by_ending.column("ending").to_numpy()
    tokens[at], types[at] = by_ending.column("n").to_numpy(), by_ending.column("v").to_numpy()
    own = min(OUTPUTS, len(h))
    np.subtract.at(tokens, ending[:own], n[:own])
    np.subtract.at(types, ending[:own], 1)
    leading = np.argsort(-tokens, kind="stable")[:CLASSES]
    leading = leading[tokens[leading] > 0]
    first = 1 + own
    class_of = np.full(1 << 16, first + len(leading), np.int64)
    class_of[leading] = first + np.arange(len(leading))
    size = first + len(leading) + 1
    class_tokens, class_words = (np.bincount(class_of, weights=x, minlength=size).astype(np.int64) for x in (tokens, types))
    outputs = np.concatenate([1 + np.arange(own), class_of[ending[own:]]])
    order = np.argsort(h.view(np.uint64))
    return Vocabulary(h.view(np.uint64)[order], n[order], outputs[order], class_of, class_tokens, class_words, int(totals[0]) + ends, int(totals[1]) + (ends > 0), ends)


def neighbours(words: Words, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the texts, ends included: its text, output, context and count (-1: not in the dictionary, words only)."""
    out, count = vocab.read(words)
    n_texts = len(words.first) - 1
    # An end after each text's words.
    ends = words.first[1:] + np.arange(n_texts)
    outputs = np.full(len(words) + n_texts, END, np.int64)
    counts = np.full(len(outputs), vocab.ends, np.int64)
    is_word = np.ones(len(outputs), bool)
    is_word[ends] = False
    outputs[is_word], counts[is_word] = out, count
    context = np.concatenate([[vocab.size], outputs[:-1]])
    context[ends[:-1] + 1] = vocab.size
    return np.repeat(np.arange(n_texts), words.counts + 1), outputs, context, counts


def pair_counts(docs: DataFrame, shared, size: int) -> np.ndarray:
    """How often each output follows each context; summed in tasks, (size + 1) * size cells at most in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, table = shared.value, None
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                _, out, context, _ = neighbours(words_of(data, offsets), vocab)
                cells = np.bincount(context * size + out, minlength=(size + 1) * size)
                table = cells if table is None else table + cells
        if table is not None:
            cell = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(table[cell])], names=["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((size + 1) * size)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(size + 1, size)


def train(table: np.ndarray, seed: int = 7) -> np.ndarray:
    """Normalised natural log-probabilities, contexts by outputs, of the model fitted to the counts."""
    contexts, size = table.shape
    rng = np.random.default_rng(seed)
    per_context = table.sum(axis=1, keepdims=True)
    total = max(table.sum(), 1)
    noise = (table.sum(axis=0) + 1) / (total + size)
    weight, mass = (table / total).astype(np.float32), (NOISE * per_context / total * noise).astype(np.float32)
    offset = np.log(NOISE * noise).astype(np.float32)
    r, q, c = (rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.1, (size, SIZE)), (0.1, (contexts, SIZE)), (0.01, (SIZE, SIZE))))
    c += np.eye(SIZE, dtype=np.float32)
    b = np.log(noise).astype(np.float32)
    params = [r, q, c, b]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1 if table.any() else 1):
        qc = q @ c
        data = 1 / (1 + np.exp(-(qc @ r.T + b - offset)))  # the probability that a token is data, not noise
        up = weight - (weight + mass) * data
        grads = [up.T @ qc, (up @ r) @ c.T, q.T @ (up @ r), up.sum(axis=0)]
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    scores = (q @ c) @ r.T + b
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def scored(docs: DataFrame, shared) -> DataFrame:
    """For each row one row with m = 0: its sums so far; and one for each of its words outside the dictionary: h and m, how often."""
    names = ["key", "doc_id", "held_out", "h", "m", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, table = shared.value
        log_table = table / np.log(10)
        below = np.log10(vocab.tokens + vocab.distinct + 1)
        in_class = np.log10(vocab.class_tokens + vocab.class_words + 1.0)
        in_class[: 1 + min(OUTPUTS, len(vocab.hashes))] = 0
        is_class = np.arange(vocab.size) >= 1 + min(OUTPUTS, len(vocab.hashes))
        for batch in batches:
            for at, to, data, offsets in slices(batch.column("text")):
                words = words_of(data, offsets)
                text, out, context, count = neighbours(words, vocab)
                n = to - at
                more = np.log10(np.maximum(count, 0) + 1.0)
                score = log_table[context, out] - in_class[out] + np.where(is_class[out], more, 0)
                base = np.bincount(text, weights=more - below, minlength=n)
                score = np.bincount(text, weights=score, minlength=n)
                known = np.bincount(text, weights=count > 0, minlength=n).astype(np.int64)
                rows = batch.slice(at, n)
                fields = [rows.column("key"), rows.column("doc_id"), rows.column("held_out"), rows.column("key"), pa.array(np.zeros(n, np.int64)), pa.array(words.counts.astype(np.int64) + 1), pa.array(known), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(fields, names=names)
                is_word = np.ones(len(out), bool)
                is_word[words.first[1:] + np.arange(n)] = False
                rare = count[is_word] < 0
                if rare.any():
                    h, owner = words.hashes()[rare], text[is_word][rare]
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
                    m = np.diff(np.append(new, len(h)))
                    none = lambda t: pa.nulls(len(new), t)
                    yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(owner[new])), none(pa.int64()), none(pa.bool_()), pa.array(h[new].view(np.int64)), pa.array(m.astype(np.int64)), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())], names=names)

    return docs.select("key", "doc_id", "held_out", "text").mapInArrow(run, "key long, doc_id long, held_out boolean, h long, m long, n_tokens long, n_known long, base double, score double")


def model_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    training = rows.filter(~F.col("held_out"))
    counts = materialise(word_counts(training), "words")
    vocab = vocabulary(counts, training.count())
    shared = spark.sparkContext.broadcast(vocab)  # DICTIONARY words
    table = train(pair_counts(training, shared, vocab.size))
    model = spark.sparkContext.broadcast((vocab, table.astype(np.float32)))  # and (outputs + 1) * outputs cells
    parts = materialise(scored(rows, model), "scores")
    # A rare word's log10(n + 1) is still missing, from the base and the model's score alike.
    rare = parts.select("key", "h", "m").join(counts.select("h", "n"), "h", "left")
    n = F.when(F.col("m") > 0, F.coalesce("n", F.lit(0))).otherwise(0)
    sums = rare.groupBy("key").agg(F.sum(F.col("m") * F.log10(n + 1.0)).alias("more"), F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("known"), F.sum((F.col("m") == 0).cast("long")).alias("copies"))
    whole = parts.filter("m = 0").join(sums, "key")
    more, known = F.col("more") / F.col("copies"), (F.col("known") / F.col("copies")).cast("long")
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
