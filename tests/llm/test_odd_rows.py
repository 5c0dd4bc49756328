"""Every operator and stage on nulls, empties, ties, repeats, clashing names and empty tables, against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from fixtures import WORD, documents, empty, lower, prose, texts
from pyspark.sql import functions as F

import corpus_pipeline
from framefold.llm import chat, decontaminate, language_model, licenses, packing, quality_classifier, quality_rules, sharding, simhash, storage, substring_dedup

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def bare(text):
    return WORD.findall(re.sub(r"[!-/:-@\[-`{-~]", "", text.lower()))


def components(items, linked):
    """Items to the least item that each reaches."""
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def test_quality(docs, spark):
    got = rows_of(quality_rules.quality_report(docs))
    want = collections.Counter()
    for i, t in texts():
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(24)) <= kept and not kept & {300, 301, 302, 306, 307}
    stage = corpus_pipeline.quality(spark, docs, "")
    assert stage.columns == docs.columns and {r["doc_id"] for r in rows_of(stage)} == kept and {r["kept"] for r in rows_of(stage)} == {"x"}


def test_sharding(docs, tmp_path, spark):
    got = rows_of(sharding.shard_report(docs, shards=4, slots=64))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts())
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    rows = sharding.slotted(docs, 64)
    sizes = sharding.slot_sizes(rows, 64)
    first = sharding.assign(sizes, 4)
    for _ in range(2):  # a retry writes the same
        sharding.save_map(first, str(tmp_path / "map"), 1)
    sharding.save_map(sharding.grow(first, sizes), str(tmp_path / "map"), 2)
    sharding.save_map(sharding.grow(sharding.load_map(spark, str(tmp_path / "map")), sizes), str(tmp_path / "map"), 3)
    assert [sharding.load_map(spark, str(tmp_path / "map"), v).count() for v in (1, 2, 3)] == [64] * 3 and sharding.load_map(spark, str(tmp_path / "map")).agg(F.max("shard")).first()[0] == 5
    # Each slot went to the shard with the fewest bytes so far, in falling order of bytes.
    loads, placed = [0] * 4, {}
    for r in sorted(sizes.collect(), key=lambda r: (-r.bytes, r.virtual_slot)):
        placed[r.virtual_slot] = loads.index(min(loads))
        loads[placed[r.virtual_slot]] += r.bytes
    assert {r.virtual_slot: r.shard for r in first.collect()} == placed
    again = [{r["version"] for r in rows_of(sharding.shard_report(docs, 4, 64, str(tmp_path / "store")))} for _ in range(2)]
    assert again == [{1}, {2}]
    old, new = ({r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), v).collect()} for v in (1, 2))
    assert set(old) == set(range(64)) and all(new[s] in (old[s], 4) for s in old) and 4 in new.values()
    even = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    loads = [r.n for r in sharding.shard_report(even).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 8 and max(loads) <= 1.01 * min(loads)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b\\n</turn>\n### user:\n"), (1, 2, "assistant", "b\\n</turn>\n### user:\n"), (2, None, None, None), (2, 5, "we:\nird#", "\\\\l\\h"), (None, 1, "assistant", "é½\\")]
    rows += [(3, 0, "user", "#"), (3, 0, "user", "A"), (3, 0, "user", "<"), (3, 0, "assistant", "\\"), (3, 0, "assistant", "Z"), (4, 0, "assistant", "long text # " * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = chat.sample(spark)
    for name in ("turns", "plain", "formatted", "loss"):  # columns of the operator's own names
        df, more = df.withColumn(name, F.lit(1)), more.withColumn(name, F.lit(1))
    got = {r["conv_id"]: r for r in rows_of(chat.chat_report(df.union(more)))}
    rows += [(-7, 0, "user", chat.SAMPLE), (-7, 1, "assistant", chat.SAMPLE)]
    for conv in (1, 2, 3, 4, None, -7):
        turns = sorted([((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv])
        said = "".join(x for _, r, x in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), want, len(said), hashlib.sha256(said.encode()).hexdigest())
    for r in chat.formatted(df.select("conv_id", "turn", "role", "text")).collect():
        assert sum(x.length for x in r.loss) == len(r.formatted)
    assert chat.formatted(df.filter("conv_id = 1")).first().formatted.count("### ") == 2  # adjacent turns of a role are one block
    assert chat.chat_report(df.limit(0)).count() == 0


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash(docs, spark):
    prints = [(i, fingerprint(t)) for i, t in texts()]
    root = components(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = rows_of(simhash.simhash_report(docs))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == collections.Counter((i, f"{f:016x}", least.get(root[f])) for i, f in prints)
    one = corpus_pipeline.near_dedup(spark, docs, "")
    kept = [r["doc_id"] for r in rows_of(one)]
    assert sorted(kept) == sorted(least.values()) and one.columns == docs.columns


def test_trie_walk_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    flips = base[rng.integers(0, 30, 900)].copy()
    for k in range(900):
        for bit in rng.integers(0, 64, rng.integers(0, 6)):
            flips[k] ^= np.uint64(1) << np.uint64(bit)
    flips = np.unique(flips)
    links = set()
    for turn, half in simhash.ORDERS:
        rows = np.sort(simhash.rotated(flips, turn))
        back = simhash.rotated(rows, 64 - turn if turn else 0)
        for i, j in simhash.walk(rows, rows, half, simhash.ERRORS, True):
            links |= {tuple(sorted(p)) for p in zip(back[i].tolist(), back[j].tolist()) if p[0] != p[1]}
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(flips.tolist(), 2) if (a ^ b).bit_count() <= 4}
    assert links == want


def paragraphs_in(t):
    """First word and words of each line, or run of shorter lines, of PASSAGE words or more."""
    found, at, held = [], 0, []
    for line in [*(t or "").split("\n"), ""]:
        words = bare(line)
        if held and not 0 < len(words) < substring_dedup.PASSAGE:
            found.append((at - len(held), held))
            held = []
        if len(words) >= substring_dedup.PASSAGE:
            found.append((at, words))
        elif words:
            held = held + words
        at += len(words)
    return [(a, tuple(w)) for a, w in found if len(w) >= substring_dedup.PASSAGE]


def test_substring_dedup(docs, spark):
    rows = sorted(texts(), key=lambda r: (r[0] is None, r[0] or 0))
    where, sets, windows = collections.defaultdict(list), {}, {}
    for n, (_, t) in enumerate(rows):
        for at, words in paragraphs_in(t):
            where[words].append((n, at))
            sets[words] = {words[j : j + 5] for j in range(len(words) - 4)}
        words = bare(t or "")
        for k in range(len(words) - 49):
            windows.setdefault(tuple(words[k : k + 50]), n)
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = components(sorted(sets), near)
    groups, cut = collections.defaultdict(list), collections.defaultdict(set)
    for words, places in where.items():
        groups[root[words]] += [(n, at, len(words)) for n, at in places]
    for places in groups.values():
        for n, at, size in sorted(places)[1:]:
            cut[n] |= set(range(at, at + size))
    for n, (_, t) in enumerate(rows):
        words = bare(t or "")
        for k in range(len(words) - 49):
            if windows[tuple(words[k : k + 50])] != n:
                cut[n] |= set(range(k, k + 50))
    left = collections.Counter((i, " ".join(w for k, w in enumerate(bare(t or "")) if k not in cut[n])) for n, (i, t) in enumerate(rows))
    got = rows_of(substring_dedup.dedup_report(docs))
    assert collections.Counter((r["doc_id"], " ".join(bare(r["text"] or ""))) for r in got) == left
    by_id = dict(texts())
    assert all(r["text"] == by_id[r["doc_id"]] for r in got if not r["n_cut"] and r["doc_id"] not in (None, 500))
    assert len([r for r in got if "p10 p11" in (r["text"] or "")]) == 1
    stage = corpus_pipeline.paragraph_dedup(spark, docs, "")
    assert stage.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in rows_of(stage.filter("text is not null")))


def test_substring_dedup_of_equal_rows(spark):
    rng = random.Random(5)
    text = " ".join(f"e{rng.randrange(10**9)}" for _ in range(55))
    for i in (7, None):
        df = spark.createDataFrame([(i, text)] * 5 + [(8, "other")], "doc_id long, text string").repartition(3)
        assert sorted(r["text"] for r in rows_of(substring_dedup.deduplicated(df))) == ["", "", "", "", text, "other"] or i is None
        assert sum(r["text"] == text for r in rows_of(substring_dedup.deduplicated(df))) == 1


def test_substring_dedup_of_a_long_text_and_clashing_names(spark):
    rng = random.Random(6)
    words = [f"l{rng.randrange(10**9)}" for _ in range(60000)]
    rows = [(1, " ".join(words), "a", "b"), (2, "start\n" + " ".join(words[20000:59999]), "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, __row string")
    got = {r["doc_id"]: r for r in rows_of(substring_dedup.deduplicated(df))}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "start" and got[2]["spans"] == "a" and got[2]["__row"] == "b"


def test_substring_dedup_beyond_the_first_occurrence(spark):
    rng = random.Random(8)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    core, left, right = new(32), new(30), new(30)
    rows = [(1, new(60) + core + new(60)), (2, new(70) + left + core + right + new(60)), (3, new(90) + left + core + right + new(60)), (4, new(80) + core + new(70))]
    got = {r["doc_id"]: r for r in rows_of(substring_dedup.dedup_report(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")))}
    assert [got[i]["n_cut"] > 0 for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert set(got[3]["text"].split()) & set(core) == set()


def test_decontamination(docs, spark):
    item = "bench mark item number one has exactly these words in this order for all to see"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three"), (None, "absent words only here")], "item_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(decontaminate.contamination(docs, bench))}
    assert {i for i, r in got.items() if r["contaminated"]} == {304, 501} and got[501]["items"] == [1]
    words = ("before " + item.upper() + "! after").split()
    for a, b in itertools.combinations(range(1, 17), 2):  # any two words changed, where 13 words in a row may still be like the item
        changed = [w if k not in (a, b) else "zzz" for k, w in enumerate(words)]
        if (a, b) in ((3, 9), (5, 13), (1, 8)):
            one = spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string")
            assert decontaminate.contamination(one, bench).first().contaminated
    stage = decontaminate.clean(docs, bench)
    assert stage.columns == docs.columns and stage.count() == len(texts()) - 2
    whole, decontaminate.BLOCK = decontaminate.BLOCK, 8
    try:
        parts = {r["doc_id"]: r["contaminated"] for r in rows_of(decontaminate.contamination(docs, bench))}
        assert parts == {i: r["contaminated"] for i, r in got.items()} and decontaminate.clean(docs, bench).count() == len(texts()) - 2
    finally:
        decontaminate.BLOCK = whole
    assert not decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count()


def test_short_items_with_one_word_changed(spark):
    for n in (5, 6, 7):
        words = [f"s{k}" for k in range(n)]
        bench = spark.createDataFrame([(n, " ".join(words))], "item_id long, text string")
        rows = [(k, " ".join(["x", *words[:k], "zzz", *words[k + 1 :], "y"])) for k in range(n)]
        got = {r["doc_id"] for r in rows_of(decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench)) if r["contaminated"]}
        assert got == set(range(1, n - 1))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.choice([16, 20, 40]))]) for k in range(12)] + [(None, [rng.choice(vocabulary) for _ in range(25)])]
    items.append((50, "hot hot hot hot hot hot hot hot hot hot hot hot hot hot".split()))
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]
        if k % 3:
            item = rng.choice(items)[1]
            a = rng.randrange(0, len(item) - 8)
            part = item[a : a + rng.randrange(8, 41)]
            part = [w if rng.random() > 0.08 else "other" for w in part]
            words[10:10] = part
        rows.append((k, words))
    rows += [(98, ["before", *items[12][1]]), (99, ["hot"] * 400)]

    def leaked(words, item):
        least = min(13, len(item))
        for shift in range(-len(item), len(words)):
            equal = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(item)]
            for a in range(len(item)):
                for b in range(a + least, len(item) + 1):
                    if equal[a] and equal[b - 1] and 0 <= a + shift and b + shift <= len(words) and 5 * sum(equal[a:b]) >= 4 * (b - a):
                        return True
        return False

    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r["doc_id"]: set(r["items"]) for r in rows_of(decontaminate.contamination(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), bench))}
    want = {i: {k for k, item in items if leaked(words, item)} for i, words in rows}
    assert got == want and any(None in x for x in want.values()) and 50 in want[99]


def test_seeds_survive_substitutions():
    for n, k in ((13, 2), (16, 3)):
        for gone in itertools.combinations(range(n), k):
            assert any(all(m[j] == "0" or p + j not in gone for j in range(len(m))) for m in decontaminate.MASKS for p in range(n - len(m) + 1))


def test_best_stretch_against_all_stretches():
    rng = np.random.default_rng(4)
    for _ in range(400):
        equal = rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.75, 0.9])
        sizes = [b - a for a in range(len(equal)) for b in range(a + 13, len(equal) + 1) if equal[a] and equal[b - 1] and 5 * equal[a:b].sum() >= 4 * (b - a)]
        got = decontaminate.best_stretch(equal, 13)
        assert (got[1] - got[0] if got else 0) == max(sizes, default=0)


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = rows_of(packing.pack(docs, TOKENIZER, with_ids=True))
    ids = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in texts())
    by = collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    total = 0
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and (at & (at - 1)) == 0  # no padding at all
        total += at
    assert total == sum(len(x) * n for (_, x), n in ids.items())
    once = {i for (i, _), n in ids.items() if n == 1} - {None, 500}
    for i, x in ids:
        if i in once:
            own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
            assert tuple(k for p in own for k in p["ids"]) == x and {p["doc_tokens"] for p in own} == {len(x)}


def test_packing_limits():
    rng = np.random.default_rng(2)
    examples = []
    for k, n in enumerate(rng.integers(1, 300, 200)):
        mask = rng.random(n) < rng.choice([0.1, 0.5, 0.9])
        examples.append((k, np.zeros(n, "<u4"), np.concatenate([[0], np.cumsum(mask)])))
    for most_segments, most_loss in ((3, 128), (64, 40), (2, 30)):
        seen, by, fullest = [[] for _ in examples], collections.defaultdict(list), 0
        for s, pieces in packing.pack_group(examples, 128, most_segments, most_loss):
            by[s] += pieces
        for pieces in by.values():
            bearing = sum(examples[x][2][a + n] - examples[x][2][a] for x, a, n in pieces)
            fullest = max(fullest, bearing)
            assert len(pieces) <= most_segments and sum(n for _, _, n in pieces) <= 128 and bearing <= most_loss
            for x, a, n in pieces:
                seen[x] += range(a, a + n)
        assert all(sorted(got) == list(range(len(x[1]))) for got, x in zip(seen, examples)) and (most_loss == 128 or fullest == most_loss)


def test_packing_of_conversations_under_a_loss_limit(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} of talk {c} " * (3 + c)) for c in range(12) for t in range(6)]
    talks = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pieces = rows_of(packing.pack(talks.withColumnsRenamed({"conv_id": "doc_id", "formatted": "text"}), TOKENIZER, 256, with_ids=True, loss="loss", most_loss=90))
    from tokenizers import Tokenizer

    tokenizer, loads, found = Tokenizer.from_file(TOKENIZER), collections.Counter(), collections.defaultdict(list)
    bearing = {}
    for r in talks.collect():
        own, at, marks = tokenizer.encode(r.formatted, add_special_tokens=False), 0, []
        for run in r.loss:
            marks += [run.loss] * run.length
        assert len(marks) == len(r.formatted)
        bearing[r.conv_id] = ([*own.ids, 1], [marks[a] for a, _ in own.offsets] + [False])
    for p in pieces:
        ids, marks = bearing[p["doc_id"]]
        assert p["ids"] == ids[p["start"] : p["start"] + p["length"]]
        loads[p["sequence_id"]] += sum(marks[p["start"] : p["start"] + p["length"]])
        found[p["doc_id"]] += range(p["start"], p["start"] + p["length"])
    assert max(loads.values()) <= 90 and all(sorted(found[c]) == list(range(len(ids))) for c, (ids, _) in bearing.items())


def test_language_model(docs):
    language_model.DICTIONARY, kept = 50, language_model.DICTIONARY
    try:
        got = rows_of(language_model.model_report(docs))
    finally:
        language_model.DICTIONARY = kept
    tokens = [(i, [*WORD.findall(lower(t or "")), 0], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in texts()]
    counts = collections.Counter(w for _, ws, held in tokens if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((i, held, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws, held in tokens)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_language_model_is_normalised():
    table = language_model.train(np.random.default_rng(0).integers(0, 9, (6, 5)).astype(float))
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-5)


def test_classifier(docs, spark):
    labels = spark.createDataFrame([(k, int(k < 300)) for k in (*range(24), 100, 101, 300, 302, 303, 306, 307)] + [(None, 1), (5, None), (401, 1)], "doc_id long, quality int")
    got = rows_of(quality_classifier.classified(docs, quality_classifier.fitted(docs, labels)))
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    none = rows_of(quality_classifier.classified(docs, quality_classifier.fitted(docs, labels.limit(0))))
    assert {r["score"] for r in none} == {0.5}


def test_pair_sum_by_squares():
    machine = quality_classifier.Machine()
    index, value = np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0], np.float32)
    v = machine.factors[index] * value[:, None]
    pairs = sum(v[a] @ v[b] for a, b in itertools.combinations(range(3), 2))
    assert np.isclose(machine.raw(np.array([0, 3]), index, value)[0][0], pairs, atol=1e-6)


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"].upper().replace("SUBLICENSE", "sub-license")
    rows = [(1, "Copyright (c) 2001 A. Body\n\n" + mit), (2, "text\nreleased under the MIT licence\nmore"), (3, None), (None, ""), (4, "All rights reserved."), (4, "All rights reserved.")]
    got = rows_of(licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))))
    found = sorted((r["doc_id"] or 0, r["license"] or "", tuple(r["licenses"]), r["n_notices"]) for r in got)
    assert found == [(0, "", (), 0), (1, "MIT", ("MIT",), 0), (2, "", ("MIT",), 1), (3, "", (), 0), (4, "ARR", ("ARR",), 1), (4, "ARR", ("ARR",), 1)]


def test_pipeline_whole(docs, spark, tmp_path):
    bench = spark.createDataFrame([(1, "bench mark item number one has exactly these words in this order for all to see")], "item_id long, text string")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    pieces = rows_of(corpus_pipeline.run(spark, str(tmp_path / "some")))
    kept = {r["doc_id"] for r in rows_of(quality_rules.quality_report(docs)) if r["kept"]}
    held = documents(spark).filter(F.col("doc_id").isin(*kept - {None}) | F.col("doc_id").isNull()).cache()
    prints = {r["doc_id"]: r["component_id"] for r in rows_of(simhash.simhash_report(held)) if r["doc_id"] is not None}
    assert {p["doc_id"] for p in pieces} == set(prints.values()) - {501}
    assert all(sum(q["length"] for q in pieces if q["doc_id"] == i) == p["doc_tokens"] for p in pieces for i in [p["doc_id"]])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_empty_tables(spark):
    none = empty(spark)
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for made in (
        quality_rules.quality_report(none), sharding.shard_report(none, 4, 16), simhash.simhash_report(none), substring_dedup.dedup_report(none), decontaminate.contamination(none, bench),
        packing.pack(none, TOKENIZER), language_model.model_report(none), quality_classifier.classified(none, quality_classifier.fitted(none, labels)), licenses.license_report(none),
    ):
        assert made.count() == 0
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.paragraph_dedup):
        made = stage(spark, none, "")
        assert made.count() == 0 and made.columns == none.columns
    assert decontaminate.clean(none, bench).count() == 0


def test_substring_dedup_of_wrapped_lines(spark):
    rng = random.Random(11)
    words = [f"q{k}" for k in range(70)]
    wrapped = "\n".join(" ".join(words[k : k + 10]) for k in range(0, 70, 10))
    changed = "\n".join(" ".join(words[k : k + 14]) for k in range(0, 70, 14)).replace("q69", "changed")
    rows = [(1, prose(rng, 60, 30) + "\n\n" + wrapped), (2, "Title\n\n" + wrapped + "\n\n" + prose(rng, 60, 30)), (3, changed + "\n\nnotes"), (4, "only\nshort lines\nhere")]
    got = {r["doc_id"]: r for r in rows_of(substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")))}
    by_id = dict(rows)
    assert got[1]["text"] == by_id[1] and got[4]["text"] == by_id[4] and got[1]["n_cut"] == got[4]["n_cut"] == 0
    assert {(c["word"], c["n"], c["kept_doc_id"], c["kept_word"]) for c in got[2]["spans"]} == {(1, 70, 1, 60)}
    assert got[2]["text"] == by_id[2].replace(wrapped + "\n", "") and got[3]["text"] == "\nnotes"


def test_passages_wherever_they_stand(spark):
    rng = random.Random(12)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    wrap = lambda words, n: "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))
    one, two, short, long = new(60), new(120), new(49), new(90)
    rows = [
        (1, " ".join(new(70) + one + new(70))), (2, " ".join(new(90) + one + new(90))), (3, wrap(new(40) + one + new(40), 13)), (4, wrap(new(60) + two, 90)), (5, " ".join(new(55) + two + new(20))),
        (6, " ".join(new(30) + short + new(30))), (7, " ".join(new(40) + short + new(40))), (8, " ".join(long)), (9, wrap(long, 20) + "\n\n - \n"), (10, " ".join(new(80) + long[30:] + new(10) + one[5:])), (None, " ".join(new(80) + [w.upper() + "," for w in one] + new(40))),
    ]
    first = {}
    for i, t in rows:
        words = bare(t)
        for k in range(len(words) - 49):
            first.setdefault(tuple(words[k : k + 50]), (i, k))
    got = {r["doc_id"]: r for r in rows_of(substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))}
    for i, t in rows:
        words = bare(t)
        cut = {k + j for k in range(len(words) - 49) if first[tuple(words[k : k + 50])][0] != i for j in range(50)}
        assert bare(got[i]["text"]) == [w for k, w in enumerate(words) if k not in cut], i
        assert {s["word"] + j for s in got[i]["spans"] for j in range(s["n"])} == cut
        assert got[i]["n_cut"] == len(got[i]["spans"]) and (got[i]["n_cut"] > 0) == bool(cut)
        for s in got[i]["spans"]:
            assert bare(dict(rows)[s["kept_doc_id"]])[s["kept_word"] :][: s["n"]] == words[s["word"] :][: s["n"]]
    assert all(got[i]["n_cut"] for i in (2, 3, 5, 9, 10, None)) and not got[7]["n_cut"]


def test_substring_dedup_discards_units_before_it_fetches(spark, monkeypatch):
    made, there, fetched = [], [], substring_dedup.fetched

    def spied(docs, wants):
        there.extend(t.framefold_path for t in made if storage.exists(spark, t.framefold_path))
        return fetched(docs, wants)

    monkeypatch.setattr(substring_dedup, "fetched", spied)
    text = " ".join(f"w{k}" for k in range(80))
    with storage.recorded(made):
        got = rows_of(substring_dedup.dedup_report(spark.createDataFrame([(1, text), (2, "other " + text), (3, "short")], "doc_id long, text string")))
    assert {r["doc_id"]: r["n_cut"] > 0 for r in got} == {1: False, 2: True, 3: False}
    assert there and not any("-pieces-" in x for x in there)
    left = [t.framefold_path for t in made if storage.exists(spark, t.framefold_path)]
    assert not any(f"-{name}-" in x for name in ("pieces", "lines", "members") for x in left)


def test_whole_licenses(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    items = ["* " + x for x in (licenses.SOURCE, licenses.BINARY)]
    bsd = "\n\n".join([licenses.REDISTRIBUTION, *items, licenses.DISCLAIMER])
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 A. Body\n\n" + licenses.KNOWN["MIT"].replace(", ", ",\n")), ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, A. Body\n\n" + bsd), ("BSD-3-Clause", bsd.replace(items[1], items[1] + "\n" + licenses.ENDORSE))]
    rows += [(p.stem, p.read_text().replace("\n", "\r\n")) for p in sorted(folder.glob("*.txt"))] + [("Unlicense", licenses.UNLICENSE + "\n" + licenses.LINK), (None, bsd + " more")]
    got = rows_of(licenses.license_report(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")))
    assert {r["doc_id"]: r["license"] for r in got} == {k: name for k, (name, _) in enumerate(rows)}
