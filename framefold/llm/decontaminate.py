"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and stripped of ASCII punctuation. A seed is a mask over
neighbouring words; the words at its marked places are hashed and the others
ignored, so a substituted word under an ignored place does not hide a match.
Every place of every text is hashed under every mask and joined with the
hashes of the benchmark. Around each hit the two are compared word by word on
that alignment. A text is contaminated if a stretch of at least LEAST words
(or as many as the item has, if that is fewer) begins and ends equal and is
equal in SIMILAR of its places; the longest such stretch is reported.
Items of 5 to 7 words have masks of their own length that ignore one inner word
each; shorter ones are looked for whole.

The benchmark is read in blocks of at most BLOCK hashes, a bound on what is
sent to each task and held by the driver; a larger benchmark takes more passes
over the texts, each written before the next, and the texts are never shuffled. A hit is verified in the task that found it.

Defined cases: null and wordless texts and items match nothing; repeated rows
are judged each on their own; null ids are carried as null; extra columns are
ignored; an empty benchmark leaves all clean; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free_name, materialise
from .text import ODD, lower_slices, mix, release, slices, words_of

#: 1: compared, 0: ignored. Whichever 2 of 13 words, or 3 of 16, are substituted, one of them still hits.
MASKS = ["11111", "1101011", "11001101", "1010011001"]
LEAST, SIMILAR = 13, 0.8
BLOCK = 1 << 20
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def bare_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, in lower case already, without punctuation, and each text's first (one more at the end)."""
    # Punctuation is taken out first, so that words are what is left between spaces.
    ink = ~PUNCTUATION[data]
    upto = np.concatenate([[0], np.cumsum(ink)])
    words = words_of(data[ink], upto[offsets], lower=False)
    return words.hashes(), words.first


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the marked words at each place; the mask is part of it."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(ODD) + words[k : k + n]
    return mix(out)


@dataclass
class Index:
    """A block of the benchmark: item ids, their words, and sorted seed hashes with the word they start at."""

    items: list[int | None]
    words: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    at: np.ndarray

    @property
    def item_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.items)), np.diff(self.first))


def masks_for(n: int) -> list[str]:
    """The masks for an item of n words; below 8 words all of its length that ignore one inner word, or that ignore none below 5."""
    if n >= 8:
        return [m for m in MASKS if len(m) <= n]
    return ["1" * k + "0" + "1" * (n - 1 - k) for k in range(1, n - 1)] if n >= 5 else ["1" * n] if n else []


def indexes(benchmark: pd.DataFrame) -> Iterator[Index]:
    """Blocks of at most BLOCK hashes (one item at least)."""
    column = pc.utf8_lower(pa.array(benchmark["text"], pa.string()))
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0
    for at, _, data, offsets in slices(column):
        words, first = bare_words(data, offsets)
        for k in range(len(first) - 1):
            own = words[first[k] : first[k + 1]]
            if not len(own):
                continue
            if held and size + len(own) * len(MASKS) > BLOCK:
                yield index(held)
                held, size = [], 0
            held.append((benchmark["item_id"].iloc[at + k], own))
            size += len(own) * len(MASKS)
    if held:
        yield index(held)


def index(items: list[tuple[int | None, np.ndarray]]) -> Index:
    first = np.concatenate([[0], np.cumsum([len(w) for _, w in items])])
    hashes, at = [], []
    for (_, words), start in zip(items, first):
        for mask in masks_for(len(words)):
            h = seed_hashes(words, mask)
            hashes.append(h)
            at.append(start + np.arange(len(h)))
    hashes, at = np.concatenate(hashes), np.concatenate(at)
    order = np.argsort(hashes, kind="stable")
    ids = [None if pd.isna(i) else int(i) for i, _ in items]
    return Index(ids, np.concatenate([w for _, w in items]), first, hashes[order], at[order])


def best_stretch(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """The longest stretch of least places or more that begins and ends equal and is equal in SIMILAR of its places."""
    # A stretch is similar enough if the sum over it of (1 - SIMILAR) and -SIMILAR is not below 0; in whole hundredths.
    need = round(100 * SIMILAR)
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 100 - need, -need))])
    starts = np.flatnonzero(equal)
    if not len(starts):
        return None
    ends = starts + 1
    low = np.minimum.accumulate(gain[starts])
    # The first start whose gain is no higher than the gain at each end.
    first = starts[np.minimum(np.searchsorted(-low, -gain[ends]), len(starts) - 1)]
    size = np.where((ends > first) & (gain[first] <= gain[ends]), ends - first, 0)
    k = int(np.argmax(size))
    return (int(first[k]), int(ends[k])) if size[k] >= least else None


def matches(words: np.ndarray, first: np.ndarray, bench: Index, masks: list[str], filter_: np.ndarray, item_of: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Verified overlaps: text, item, first word and number of words in the text, first word in the item, equal words."""
    seen: set[tuple[int, int, int]] = set()
    n_words = len(words)
    for mask in masks:
        own = seed_hashes(words, mask)
        maybe = np.flatnonzero(filter_[own & np.uint64(len(filter_) - 1)])
        low = np.searchsorted(bench.hashes, own[maybe], "left")
        high = np.searchsorted(bench.hashes, own[maybe], "right")
        hit = high > low
        places, low, high = maybe[hit], low[hit], high[hit]
        text = np.searchsorted(first, places, "right") - 1
        inside = places + len(mask) <= first[text + 1]
        for p, q, t in alignments(places[inside], low[inside], high[inside], text[inside], bench, item_of):
            item, shift = int(item_of[q]), p - q
            if (t, item, shift) in seen:
                continue
            seen.add((t, item, shift))
            b0, b1 = int(bench.first[item]), int(bench.first[item + 1])
            start = max(b0, int(first[t]) - shift)
            end = min(b1, int(first[t + 1]) - shift, n_words - shift)
            equal = bench.words[start:end] == words[start + shift : end + shift]
            found = best_stretch(equal, min(LEAST, b1 - b0))
            if found:
                s, e = found
                yield t, item, start + s + shift - int(first[t]), e - s, start + s - b0, int(equal[s:e].sum())


def alignments(places: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray, bench: Index, item_of: np.ndarray, block: int = 1 << 16) -> Iterator[tuple[int, int, int]]:
    """place, posting and text of one hit of each alignment of a text with an item; a seed of many postings is taken in blocks."""
    count = high - low
    upto = np.cumsum(count)
    for at in range(0, int(upto[-1]) if len(upto) else 0, block):
        k = np.arange(at, min(at + block, int(upto[-1])))
        hit = np.searchsorted(upto, k, "right")
        q = bench.at[low[hit] + k - (upto[hit] - count[hit])]
        p, t = places[hit], text[hit]
        _, one = np.unique(np.stack([t, item_of[q], p - q]), axis=1, return_index=True)
        yield from zip(p[one].tolist(), q[one].tolist(), t[one].tolist())


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark as bounded indexes; it is fetched row by row and the driver holds one block."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        held.append(row)
        size += (len(row["text"] or "") // 2 + 1) * len(MASKS)
        if size > BLOCK:
            yield from indexes(pd.DataFrame(held, columns=["item_id", "text"]))
            held, size = [], 0
    yield from indexes(pd.DataFrame(held, columns=["item_id", "text"]))  # with no item at all there is no block


KIND = "array<struct<item_id:long,start:long,length:long,item_start:long,equal:long>>"


def with_overlaps(docs: DataFrame, block: Index, name: str, keep: list[str]) -> DataFrame:
    """The columns in keep and, as name, the verified overlaps with a block, of every row of docs."""
    arrow = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "start", "length", "item_start", "equal")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << max(16, int(len(block.hashes) * 16).bit_length())
        maybe = np.zeros(size, bool)
        maybe[block.hashes & np.uint64(size - 1)] = True
        masks = list(dict.fromkeys(m for n in np.unique(np.diff(block.first)).tolist() for m in masks_for(n)))
        item_of = block.item_of
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for at, _, data, offsets in lower_slices(batch.column("text")):
                words, first = bare_words(data, offsets)
                for t, item, start, length, item_start, equal in matches(words, first, block, masks, maybe, item_of):
                    found[at + t].append({"item_id": block.items[item], "start": start, "length": length, "item_start": item_start, "equal": equal})
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, arrow)], names=[*keep, name])
            release()

    schema = docs.select(*keep, F.lit(None).cast(KIND).alias(name)).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_overlaps, items and overlaps (words without punctuation, from 0) of every row."""
    rows, names = docs.select("doc_id", "text"), []
    for k, (block, more) in enumerate(pairwise(chain(blocks(benchmark), [None]))):
        rows, names = with_overlaps(rows, block, f"overlaps_{k}", ["doc_id", *["text"] * (more is not None), *names]), [*names, f"overlaps_{k}"]
        rows = rows if more is None else materialise(rows, "overlaps")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.expr(f"cast(array() as {KIND})"), *names).alias("overlaps"))
    return rows.select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size("overlaps").cast("long").alias("n_overlaps"),
        F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o["item_id"]))).alias("items"), "overlaps",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an overlap; one pass for each block, no shuffle."""
    columns, name = docs.columns, free_name(docs.columns, "__overlaps")
    for block, more in pairwise(chain(blocks(benchmark), [None])):
        docs = with_overlaps(docs, block, name, columns).filter(F.size(name) == 0).select(*columns)
        docs = docs if more is None else materialise(docs, "clean")
    return docs
