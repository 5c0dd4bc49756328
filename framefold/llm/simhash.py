"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Two nodes of the trie are walked down together. Their differing bits add up,
and a pair of nodes is dropped as soon as the error budget is exceeded. As 4
errors fall in two halves of 32 bits, either the upper half has 2 at most or
the lower half has 1 at most. So the trie is walked twice, once in each order
of the halves, with that budget for the first half and 4 for the whole: exact,
and far fewer node pairs than one walk with 4 from the root.

The nodes at the top of the trie are chosen on the driver from a histogram of
16-bit prefixes (65,536 rows at most); nodes that hold more fingerprints than
the capacity and cannot be split there are cut into chunks by hash. Tasks then
walk the pairs of these nodes into a written plan, and each pair of nodes, or
chunks, is one group of bounded size. Only distinct
fingerprints take part, and a group returns a spanning forest of its links
rather than all pairs, so groups of copies cost no more than other rows.

Defined cases: null and wordless texts have fingerprint 0 and are linked like
any other; 1 to 3 words make one shingle; repeated rows share a component;
null ids are ignored for the component's name, which is null if all are; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import free_name, materialise, row_hash
from .text import Words, slices, words_of

SHINGLE, SEED, ERRORS = 4, 42, 4
#: Fingerprints in one side of a group: between these, so that there are about 64 nodes or more.
LEAST_NODE, MOST_NODE = 4096, 1 << 20
TOP_BITS = 16
#: (bits to rotate, errors in the first half of the rotated word).
ORDERS = [(0, 2), (32, 1)]


def shingle_spans(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with words parted by one space, and in them the start and end of each shingle and its text."""
    space = words.data <= 32  # control bytes below \\t are ink
    space &= np.isin(words.data, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    plain = np.where(space, np.uint8(32), words.data)[keep]
    place = np.cumsum(keep) - 1
    starts, ends = place[words.starts], place[words.ends - 1] + 1 if len(words) else words.ends
    text, last = words.text_of(), words.first[1:]
    index = np.arange(len(words))
    whole = index + size <= last[text] if len(words) else np.zeros(0, bool)
    n = words.counts
    short = np.flatnonzero((n > 0) & (n < size))
    begin = np.concatenate([index[whole], words.first[short]])
    until = np.concatenate([index[whole] + size - 1, words.first[short] + n[short] - 1])
    owner = np.concatenate([text[whole], short])
    order = np.argsort(owner, kind="stable")
    begin, until = begin[order], until[order]
    return plain, starts[begin], ends[until], owner[order]


def fingerprints_of(words: Words) -> np.ndarray:
    plain, starts, ends, owner = shingle_spans(words)
    out = np.zeros(len(words.first) - 1, np.uint64)
    if not len(starts):
        return out
    raw, digest = plain.tobytes(), xxhash.xxh64_intdigest
    # Texts bounded by one byte run on into the next; no shingle spans two texts.
    hashes = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), 1 << 18):
        a, b = starts[at : at + (1 << 18)].tolist(), ends[at : at + (1 << 18)].tolist()
        hashes[at : at + len(a)] = np.fromiter((digest(raw[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
    bounds = np.searchsorted(owner, np.arange(len(out) + 1))
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    view = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[k], bounds[k + 1]
        count = np.zeros(64, np.int64)
        for at in range(a, b, 1 << 16):
            count += np.unpackbits(view[at : min(b, at + (1 << 16))], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = weights[2 * count > b - a].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and fp, the fingerprint as a signed long; text is read and dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at, to, data, offsets in slices(texts):
                fp = fingerprints_of(words_of(data, offsets)).view(np.int64)
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(fp)], names=[*keep, "fp"])

    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema
    return docs.select(*keep, "text").mapInArrow(run, schema) if "text" not in keep else docs.select(*keep).mapInArrow(run, schema)


def walk(left: np.ndarray, right: np.ndarray, half: int, errors: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of fingerprints that differ in at most half bits of the upper 32 and errors bits in all."""
    if not len(left) or not len(right):
        return
    frontier = [np.array([x]) for x in (0, len(left), 0, len(right), 0)]
    for depth in range(64):
        la, lb, ra, rb, bad = frontier
        small = (lb - la) * (rb - ra) <= 16
        yield from compare(left, right, [x[small] for x in frontier], half, errors)
        la, lb, ra, rb, bad = (x[~small] for x in frontier)
        if not len(la):
            return
        bit = np.uint64(1) << np.uint64(63 - depth)

        def middle(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
            prefix = of[a] & ~(bit | (bit - np.uint64(1)))
            return np.clip(np.searchsorted(of, prefix | bit), a, b)

        lm, rm = middle(la, lb, left), middle(ra, rb, right)
        parts = [(la, lm, ra, rm, bad), (lm, lb, rm, rb, bad), (la, lm, rm, rb, bad + 1)]
        # Both orders of a pair of different nodes are one pair if the two tries are one.
        parts.append((lm, lb, ra, rm, bad + 1))
        frontier = [np.concatenate(x) for x in zip(*parts)]
        la, lb, ra, rb, bad = frontier
        live = (la < lb) & (ra < rb) & (bad <= (half if depth < 32 else errors))
        if same:
            live &= la <= ra
        frontier = [x[live] for x in frontier]
    yield from compare(left, right, frontier, half, errors)


def compare(left: np.ndarray, right: np.ndarray, frontier: list[np.ndarray], half: int, errors: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs below small node pairs, compared whole."""
    la, lb, ra, rb, _ = frontier
    size = (lb - la) * (rb - ra)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // block, prepend=0, append=-1)) if len(size) else []
    at = 0
    for to in [*cuts, len(size)]:
        if to <= at:
            continue
        n = size[at:to]
        of = np.repeat(np.arange(at, to), n)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = la[of] + rank // (rb - ra)[of], ra[of] + rank % (rb - ra)[of]
        differ = left[i] ^ right[j]
        near = (np.bitwise_count(differ) <= errors) & (np.bitwise_count(differ >> np.uint64(32)) <= half)
        yield i[near], j[near]
        at = to


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node that it reaches by links."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits)) if bits else x


def top_nodes(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The top of the trie: for each 16-bit prefix its node, and of each node its prefix, depth and number of chunks."""
    counts = np.zeros(1 << TOP_BITS, np.int64)
    counts[list(histogram)] = list(histogram.values())
    upto = np.concatenate([[0], np.cumsum(counts)])
    node_of = np.full(1 << TOP_BITS, -1, np.int64)
    nodes: list[tuple[int, int, int]] = []  # prefix, depth, chunks
    stack = [(0, 0)]
    while stack:
        prefix, depth = stack.pop()
        low, width = prefix << (TOP_BITS - depth), 1 << (TOP_BITS - depth)
        n = int(upto[low + width] - upto[low])
        if n > capacity and depth < TOP_BITS:
            stack += [(prefix * 2, depth + 1), (prefix * 2 + 1, depth + 1)]
        elif n:
            node_of[low : low + width] = len(nodes)
            nodes.append((prefix, depth, -(-n // (2 * capacity))))
    prefix, depth, chunks = np.array(nodes, np.int64).reshape(-1, 3).T
    return node_of, prefix, depth, chunks


def planned(spark: SparkSession, prefix: np.ndarray, depth: np.ndarray, chunks: np.ndarray, half: int) -> DataFrame:
    """node, chunk, side and the group (a, x, b, y) it takes part in: chunk x of node a meets chunk y of node b.

    Tasks find the pairs of nodes within the budget, and the plan is a written table: the driver holds the nodes alone.
    """
    shared = spark.sparkContext.broadcast((prefix, depth, chunks))  # 65,536 nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, depth, chunks = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                common = np.minimum(depth[k], depth[k:])
                differ = (prefix[k] >> (depth[k] - common)) ^ (prefix[k:] >> (depth[k:] - common))
                other = k + np.flatnonzero(np.bitwise_count(differ.astype(np.uint64)) <= half)
                ends = [np.full(len(other), k), other, np.full(len(other), chunks[k]), chunks[other]]
                yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int32)) for e in ends], names=["a", "b", "n_a", "n_b"])

    pairs = spark.range(0, len(prefix), 1, max(1, len(prefix) // 512)).mapInArrow(run, "a int, b int, n_a int, n_b int")
    rows = pairs.select("a", "b", "n_b", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)).alias("x")).select("a", "x", "b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("y"))
    rows = rows.filter("a <> b or x <= y")
    # A chunk that meets itself has one side.
    sides = F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("chunk"), F.lit(0).alias("side")), F.when((F.col("a") != F.col("b")) | (F.col("x") != F.col("y")), F.struct(F.col("b").alias("node"), F.col("y").alias("chunk"), F.lit(1).alias("side"))))
    return materialise(rows.select("a", "x", "b", "y", F.explode(sides).alias("s")).filter("s is not null").select("s.node", "s.chunk", "s.side", "a", "x", "b", "y"), "trie-plan")


def links(rows: DataFrame) -> DataFrame:
    """rows (fp) to u, v: links of distinct fingerprints that connect just those which are joined by steps of ERRORS bits at most."""
    spark = rows.sparkSession
    distinct = materialise(rows.select("fp").distinct(), "fingerprints")
    capacity = int(np.clip(distinct.count() // 64, LEAST_NODE, MOST_NODE))
    found = []
    for turn, half in ORDERS:
        key = F.expr(f"shiftright(shiftleft(fp, {turn}), {64 - TOP_BITS}) & {(1 << TOP_BITS) - 1}").cast("int")
        histogram = dict(distinct.groupBy(key.alias("k")).count().collect())  # 65,536 rows at most
        if not histogram:
            continue
        node_of, prefix, depth, chunks = top_nodes(histogram, capacity)
        nodes = spark.createDataFrame(pd.DataFrame([(int(k), int(node_of[k]), int(chunks[node_of[k]])) for k in histogram], columns=["k", "node", "chunks"]), "k int, node int, chunks int")
        # The plan grows with the data, so Spark weighs its size. A key holds 2 * capacity fingerprints at most.
        placed = distinct.withColumn("k", key).join(F.broadcast(nodes), "k").select("fp", "node", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"))
        dealt = placed.join(planned(spark, prefix, depth, chunks, half), ["node", "chunk"])
        found.append(dealt.select("a", "x", "b", "y", "side", "fp").groupBy("a", "x", "b", "y").applyInArrow(joiner(turn, half), "u long, v long"))
    if not found:
        return rows.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    return found[0].union(found[1]) if len(found) > 1 else found[0]


def joiner(turn: int, half: int):
    def run(group: pa.Table) -> pa.Table:
        fp = rotated(group.column("fp").to_numpy().view(np.uint64), turn)
        side = group.column("side").to_numpy()
        left, right = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        same = not len(right)
        n = len(left)
        pairs = walk(left, left if same else right, half, ERRORS, same)
        nodes = left if same else np.concatenate([left, right])
        root = forest(len(nodes), ((i, j) if same else (i, j + n) for i, j in pairs))
        child = np.flatnonzero(root != np.arange(len(nodes)))
        back = rotated(nodes, 64 - turn if turn else 0).view(np.int64)
        return pa.table({"u": back[child], "v": back[root[child]]})

    return run


def clustered(rows: DataFrame) -> DataFrame:
    """rows (written, with fp) and root, the fingerprint that names their component."""
    roots = materialise(connected_components(links(rows)), "roots").toDF("node", "root")
    return rows.join(roots, rows["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = materialise(fingerprints(docs, ["doc_id"]), "simhash")
    # A component's least id: by fingerprint first, so that hot fingerprints shrink before any join.
    ids = clustered(rows.groupBy("fp").agg(F.min("doc_id").alias("least"))).select("fp", "root", "least")
    ids = materialise(ids, "components")
    names = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(ids.join(names, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the least doc_id (nulls last), then the least hash of the row."""
    name = free_name(docs.columns, "__row")
    marked = docs.withColumn(name, row_hash(docs))
    rows = materialise(fingerprints(marked.select("doc_id", "text", F.col(name).alias("__row")), ["doc_id", "__row"]), "simhash")
    # Per fingerprint first: a partial minimum, whatever the size of a group of copies.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("best")
    least = clustered(rows.groupBy("fp").agg(best))
    keep = materialise(least.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.__row").alias(name)), "survivors")
    # A name stands for one row of docs, or for rows equal in every column, of which one stays.
    return marked.join(keep, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
