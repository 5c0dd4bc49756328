"""Paths that only large inputs take, entered by lowered limits, and the model's score against plain Python."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
from fixtures import WORD, documents, lower, texts

from framefold.llm import language_model, quality_classifier, simhash


def classes_of(prints):
    root = {x: x for x in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= simhash.ERRORS:
            root[top(a)] = top(b)
    groups = collections.defaultdict(set)
    for x in prints:
        groups[top(x)].add(x)
    return {frozenset(g) for g in groups.values()}


def test_simhash_of_many_nodes_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_NODE", 8)
    monkeypatch.setattr(simhash, "MOST_NODE", 8)
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        # Many share 32 leading or 32 trailing bits, so nodes cannot be split there and are cut into chunks.
        x = rng.choice([rng.getrandbits(64), rng.getrandbits(32), 7 << 40 | rng.getrandbits(24), rng.getrandbits(32) << 32])
        for _ in range(8):
            prints.add(x)
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    rows = spark.createDataFrame(signed, "fp long")
    root = {r["fp"] % (1 << 64): r["root"] for r in simhash.clustered(rows).collect()}
    groups = collections.defaultdict(set)
    for x in prints:
        groups[root[x]].add(x)
    _, _, _, chunks = simhash.top_nodes(dict(collections.Counter(x >> 48 for x in prints)), 8)
    assert {frozenset(g) for g in groups.values()} == classes_of(prints) and len(chunks) > 30 and chunks.max() > 2


def scores(spark, rows, monkeypatch):
    kept = {}
    train, vocabulary = language_model.train, language_model.vocabulary

    def trained(table):
        kept["table"] = train(table)
        return kept["table"]

    def known(counts, ends):
        kept["vocab"] = vocabulary(counts, ends)
        return kept["vocab"]

    monkeypatch.setattr(language_model, "train", trained)
    monkeypatch.setattr(language_model, "vocabulary", known)
    got = [(r["doc_id"], r["n_tokens"], r["score"]) for r in language_model.model_report(rows).collect()]
    monkeypatch.setattr(language_model, "train", train)
    monkeypatch.setattr(language_model, "vocabulary", vocabulary)
    return got, kept["table"].astype(np.float32).astype(float), kept["vocab"]


def test_score_of_the_language_model(spark, monkeypatch):
    monkeypatch.setattr(language_model, "OUTPUTS", 40)
    monkeypatch.setattr(language_model, "CLASSES", 6)
    got, table, vocab = scores(spark, documents(spark), monkeypatch)
    tokens = [(i, WORD.findall(lower(t or "")), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in texts()]
    counts = collections.Counter(w for _, ws, held in tokens if not held for w in ws)
    own = 40
    outputs = dict(zip(vocab.hashes.tolist(), vocab.outputs.tolist()))

    def hash_of(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(language_model.words_of(raw, np.array([0, len(raw)])).hashes()[0])

    def output(word):
        raw = word.encode()
        ending = raw[-1] + (256 * raw[-2] if len(raw) > 1 else 0)
        return outputs.get(hash_of(word), int(vocab.class_of[ending]))

    places = {w: output(w) for w in {w for _, ws, _ in tokens for w in ws}}
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-4)
    assert len({w for w in counts if places[w] <= own}) == own
    tokens_in, words_in = collections.Counter(), collections.Counter()
    for w, n in counts.items():
        if places[w] > own:
            tokens_in[places[w]] += n
            words_in[places[w]] += 1
    want = []
    for i, ws, _ in tokens:
        before, score = table.shape[1], 0.0
        for w in [*ws, None]:
            out = 0 if w is None else places[w]
            score += table[before, out] / math.log(10)
            if out > own:
                score += math.log10((counts[w] + 1) / (tokens_in[out] + words_in[out] + 1))
            before = out
        want.append((i, len(ws) + 1, score))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-4)


def test_dictionary_of_words_equally_frequent(spark, monkeypatch):
    monkeypatch.setattr(language_model, "DICTIONARY", 5)
    rows = [(k, " ".join(f"u{k}x{j}" for j in range(20))) for k in range(12)]
    got, table, vocab = scores(spark, spark.createDataFrame(rows, "doc_id long, text string"), monkeypatch)
    assert len(vocab.hashes) == 5 and table.shape[1] > 6 and all(math.isfinite(s) and s < 0 for _, _, s in got) and len(got) == 12


def test_score_of_the_classifier(spark):
    """The machine's score is the logistic of the sum over all pairs of features."""
    rng = np.random.default_rng(3)
    machine = quality_classifier.Machine()
    machine.weights[:] = rng.normal(0, 0.3, len(machine.weights))
    machine.factors[:] = rng.normal(0, 0.3, machine.factors.shape)
    raw = "some words and some more words here\nsome words and\n\n".encode()
    bounds, index, value = quality_classifier.features_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    score = float(machine.bias) + sum(float(machine.weights[i]) * float(v) for i, v in zip(index, value))
    for (i, v), (j, w) in itertools.combinations(list(zip(index.tolist(), value.tolist())), 2):
        score += float(machine.factors[i].astype(float) @ machine.factors[j].astype(float)) * v * w
    assert math.isclose(1 / (1 + math.exp(-score)), float(machine.score(bounds, index, value)[0]), rel_tol=1e-4)


def test_classifier_of_an_id_with_several_texts(spark):
    rows = [(k, f"word{k % 3} text of row {k} " * (k % 4 + 1)) for k in range(40)] + [(k, f"another text {k}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    made = [quality_classifier.fitted(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 2), (rows[::-1], 5))]
    assert (made[0].weights == made[1].weights).all() and (made[0].factors == made[1].factors).all() and made[0].bias == made[1].bias
