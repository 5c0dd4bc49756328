"""Substring dedup by MinHash banding of paragraphs.

Texts are read in lower case and without ASCII punctuation. What is cut has
PASSAGE words or more. Paragraphs are of two kinds:

* Lines of PASSAGE words or more, and runs of shorter lines that no line
  without words parts, if they have as many in all. BANDS bands of ROWS MinHash values
  over shingles of 5 words make two of similarity 0.8 meet in some bucket with
  a probability of 0.998; those that meet are compared by the exact Jaccard
  similarity of their shingles, and linked from 0.8. In each connected
  component the one with the least (doc_id, row, word) stays, all others are cut.
* Units of UNIT words, whose places the words themselves choose: a unit starts
  at a shingle whose hash is least among some SPACING neighbours. So any
  PASSAGE words hold a unit, the same one wherever they stand and wherever
  lines break. Equal units share all MinHash values: one band of UNIT_ROWS
  brings them together, and a hash of their words tells those that are equal
  from those that are only alike. Of each group the least occurrence stays.
  Units next to each other that match neighbouring units of one row make a
  span, and a span grows word for word as far as the two texts agree: at most
  UNIT words on each side, as beyond that there would be another unit. Spans
  of PASSAGE words or more are cut.

A span that agrees with the first occurrence of its units in too few words is
compared once more with others of its kind, by hashes of all PASSAGE words
around it. A passage that repeats within one row only is not cut.

Within a bucket each paragraph is compared with the bucket's representative,
another one in each band. What is linked then needs no more comparisons among
itself. Paragraphs of one bucket of three or more that are still in different
components meet once more in FINE_BANDS bands of FINE_ROWS values, which few
but similar ones share: again with representatives first, and what is then
still apart pair by pair, if sketches of their MinHash values are alike. So
groups of copies cost no more than their rows; of the pairs with a similarity
of 0.8, the finer bands miss one in a thousand.

Rows are numbered apart, so rows that are equal in all columns are rid of
their repeats like any others. Units are told apart by 128 bits; a paragraph
whose 64-bit name also belongs to another one is left alone.

Defined cases: null texts have no paragraphs and stay null; null ids come last
and are kept as null; extra columns are kept; an empty table gives no rows. A
line that loses all its words goes; a text that loses all lines becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, free_name, let_go, materialise
from .text import IS_SPACE, ODD, Words, gram_hashes, lower_slices, mix, release, words_of

#: Words of the shortest passage that is cut, of the units by which passages are found, and of shingles.
PASSAGE, UNIT, SHINGLE = 50, 25, 5
SPACING = PASSAGE - UNIT + 1
SIMILAR = 0.8
BANDS, ROWS, UNIT_ROWS = 12, 4, 4
#: The finer bands: similarity 0.8 meets with a probability of 0.999, 0.6 with 0.2, 0.5 with 0.02.
FINE_BANDS, FINE_ROWS = 100, 12
#: One bit of each of so many MinHash values, and how many may differ: (1 - 0.8) / 2 of them would, give or take 10.
SKETCH_BITS, SKETCH_MOST = 1152, 147
#: Units handled at once.
BLOCK = 1 << 14
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def bare_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of each text without punctuation, and how many bytes are left before each byte."""
    ink = ~PUNCTUATION[data]
    upto = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(ink, out=upto[1:])
    return words_of(data[ink], upto[offsets], lower=False), upto


def paragraphs_of(data: np.ndarray, offsets: np.ndarray, words: Words, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of each line, or run of short lines, of PASSAGE words or more."""
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.append(np.searchsorted(words.starts, upto[starts]), len(words))
    count = np.diff(first)
    short = (count > 0) & (count < PASSAGE)
    new = np.ones(len(starts), bool)
    new[1:] = ~(short[1:] & short[:-1] & (text[1:] == text[:-1]))
    at = np.flatnonzero(new)
    begin, end = first[at], first[np.append(at[1:], len(starts))]
    long = end - begin >= PASSAGE
    return begin[long], end[long], text[at[long]]


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours in values."""
    if len(values) < n:
        return values[:0]
    out, width = values, 1
    while 2 * width <= n:
        out, width = np.minimum(out[:-width], out[width:]), 2 * width
    more = n - width
    return np.minimum(out[: len(out) - more], out[more:]) if more else out


def unit_starts(words: Words, grams: np.ndarray) -> np.ndarray:
    """First words of the units: starts that are least among some SPACING of PASSAGE words of one text."""
    m = len(words) - PASSAGE + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    text = words.text_of()
    least = least_of(grams[: m + SPACING - 1], SPACING).copy()
    least[text[:m] != text[PASSAGE - 1 :]] = 0
    around = np.zeros(m + 2 * (SPACING - 1), np.uint64)
    around[SPACING - 1 : SPACING - 1 + m] = least
    starts = np.flatnonzero(~least_of(~around, SPACING) == grams[: m + SPACING - 1])
    # Where words repeat in a short period, equal starts tie: those less than half of SPACING apart are thinned, so any SPACING of them still hold one.
    close = (np.diff(starts) < SPACING // 2) & (grams[starts[1:]] == grams[starts[:-1]])
    keep, last, before = np.ones(len(starts), bool), 0, -1
    for k in (np.flatnonzero(close) + 1).tolist():
        last = last if k - 1 == before else starts[k - 1]
        keep[k] = starts[k] - last >= SPACING // 2
        last, before = starts[k] if keep[k] else last, k
    return starts[keep]


def salts(count: int, seed: int = 0) -> np.ndarray:
    return mix(np.arange(1, 2 * count + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def unit_hashes(starts: np.ndarray, hashes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band and the name of each unit."""
    band, name = np.full(len(starts), BANDS + 1, np.uint64), np.zeros(len(starts), np.uint64)
    salt = salts(UNIT_ROWS)
    for at in range(0, len(starts), BLOCK):
        own = starts[at : at + BLOCK, None]
        shingles = grams[own + np.arange(UNIT - SHINGLE + 1)]
        for row in range(UNIT_ROWS):
            least = ((shingles ^ salt[2 * row]) * salt[2 * row + 1]).min(axis=1)
            band[at : at + BLOCK] = mix(band[at : at + BLOCK] * np.uint64(ODD) + least)
        for k in range(UNIT):
            name[at : at + BLOCK] = name[at : at + BLOCK] * np.uint64(ODD) + hashes[own[:, 0] + k]
    return band.view(np.int64), mix(name).view(np.int64)


def ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of count numbers from begin one after another, each number's place in its run, and where runs begin (one more at the end)."""
    bounds = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    return place + np.repeat(begin, count), place, bounds


def sequence_hashes(begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the word sequence of each paragraph."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, place, bounds = ranges(begin, end - begin)
    count = (end - begin).astype(np.uint64)
    own, place = hashes[at], place.astype(np.uint64) * np.uint64(ODD)
    one = np.add.reduceat(mix(own + place), bounds[:-1])
    two = np.add.reduceat(mix(own ^ mix(place + np.uint64(1))), bounds[:-1])
    return mix(one + count).view(np.int64), mix(two ^ count).view(np.int64)


def band_hashes(grams: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 0, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """bands longs for each paragraph, the band's number being part of each; and as longs one bit of each of the first bits values."""
    sketch = np.zeros((len(bounds) - 1, bits // 64), np.uint64)
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    salt = salts(bands * rows, seed)
    for band in range(bands):
        key = np.full(len(bounds) - 1, band + 1, np.uint64)
        for row in range(rows):
            k = 2 * (band * rows + row)
            least = np.minimum.reduceat((grams ^ salt[k]) * salt[k + 1], bounds[:-1])
            if k // 2 < bits:
                sketch[:, k // 128] |= (mix(least) & np.uint64(1)) << np.uint64(k // 2 % 64)
            key = mix(key * np.uint64(ODD) + least)
        out[:, band] = key
    return out.view(np.int64), sketch.view(np.int64)


def lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """values one after another as lists of count each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(values))


def pieces(docs: DataFrame) -> DataFrame:
    """row, doc_id, word, n, name, key (a unit's band, a paragraph's second hash), bands (null of units) of every unit and paragraph; docs has __row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column("__row"), batch.column("doc_id").cast(pa.int64())
            for at, to, data, offsets in lower_slices(batch.column("text")):
                words, upto = bare_words(data, offsets)
                begin, end, of = paragraphs_of(data, offsets, words, upto)
                if len(words) < PASSAGE:
                    continue
                hashes = words.hashes()
                grams = gram_hashes(hashes, SHINGLE)
                starts = unit_starts(words, grams)
                key, name = unit_hashes(starts, hashes, grams)
                names, checks = sequence_hashes(begin, end, hashes)
                shingles, _, bounds = ranges(begin, end - begin - SHINGLE + 1)
                bands = band_hashes(grams[shingles], bounds)[0] if len(begin) else np.zeros((0, BANDS), np.int64)
                text = np.concatenate([np.searchsorted(words.first, starts, "right") - 1, of])
                none = np.zeros(len(text), bool)
                none[: len(starts)] = True
                count = np.where(none, 0, BANDS)
                banded = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(bands.ravel()), mask=pa.array(none))
                first = np.concatenate([starts, begin])
                own = pa.array(at + text)
                columns = [rows.take(own), ids.take(own), pa.array((first - words.first[text]).astype(np.int32)), pa.array(np.concatenate([np.full(len(starts), UNIT), end - begin]).astype(np.int32)), pa.array(np.concatenate([name, names])), pa.array(np.concatenate([key, checks])), banded]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "word", "n", "name", "key", "bands"])
            release()

    return docs.select("__row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, word int, n int, name long, key long, bands array<long>")


def place() -> Column:
    """The order by which one occurrence stays."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "word")


def runs(units: DataFrame) -> DataFrame:
    """row, word, n, to_row, to_doc, shift of units in unbroken succession that match units of one row at the same distance."""
    shared = units.groupBy("key", "name").agg(F.min(place()).alias("kept"), F.min("row").alias("a"), F.max("row").alias("b")).filter("a != b").select("key", "name", "kept")
    shared = materialise(shared, "shared")
    let_go(units.sparkSession)
    at = F.struct("word", F.col("kept.row").alias("to_row"), F.col("kept.doc_id").alias("to_doc"), (F.col("kept.word") - F.col("word")).alias("shift"))
    met = units.join(shared, ["key", "name"]).filter(F.col("row") != F.col("kept.row")).select("row", at.alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("ats")
            flat, count = at.flatten(), pc.list_value_length(at).to_numpy()
            text = np.repeat(np.arange(len(batch)), count)
            word, row, shift = (flat.field(k).to_numpy() for k in ("word", "to_row", "shift"))
            new = np.ones(len(word), bool)
            new[1:] = (text[1:] != text[:-1]) | (row[1:] != row[:-1]) | (shift[1:] != shift[:-1]) | (word[1:] - word[:-1] > UNIT)
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(word)) - 1
            take = pa.array(begin)
            columns = [batch.column("row").take(pa.array(text[begin])), pa.array(word[begin]), pa.array(word[last] - word[begin] + np.int32(UNIT)), *(flat.field(k).take(take) for k in ("to_row", "to_doc", "shift"))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "word", "n", "to_row", "to_doc", "shift"])

    found = met.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("ats")).mapInArrow(run, "row long, word int, n int, to_row long, to_doc long, shift int")
    found = materialise(found, "runs")
    discard(shared)
    return found


#: What fetched() gets: shingles of a paragraph (a is its name), words beside a place (n is the side, 0 left, 1 right),
#: or the same of both sides of a run and the hashes of all PASSAGE words around a short one (a, b, shift are its to_row, to_doc, shift).
SHINGLES, BESIDE, AROUND = range(3)
WANT = "struct<kind:int,word:int,n:int,a:long,b:long,shift:int>"


def want(kind: int, word: Column, n: Column, a: Column | None = None, b: Column | None = None, shift: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind), word, n, null if a is None else a, null if b is None else b, null if shift is None else shift).cast(WANT).alias("want")


def requests(run_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, wants: what is to be fetched from each row for runs and for the wanted paragraphs (row, word, n, name)."""
    sides = F.explode(F.array(F.struct((F.col("word") + F.col("shift")).alias("at"), F.lit(0).alias("side")), F.struct((F.col("word") + F.col("n") + F.col("shift")).alias("at"), F.lit(1).alias("side"))))
    beside = run_rows.select(F.col("to_row").alias("row"), sides.alias("s")).distinct().select("row", want(BESIDE, F.col("s.at"), F.col("s.side")))
    own = run_rows.select("row", want(AROUND, F.col("word"), F.col("n"), F.col("to_row"), F.col("to_doc"), F.col("shift")))
    sets = wanted.select("row", want(SHINGLES, F.col("word"), F.col("n"), F.col("name")))
    return beside.union(own).union(sets).groupBy("row").agg(F.collect_list("want").alias("wants"))


def beside(words: Words, hashes: np.ndarray, text: np.ndarray, at: np.ndarray, side: np.ndarray) -> pa.Array:
    """The hashes of up to UNIT words to the left or right of each place, outward."""
    step = np.arange(UNIT)
    index = np.where(side[:, None] == 0, at[:, None] - 1 - step, at[:, None] + step)
    inside = (index >= words.first[text][:, None]) & (index < words.first[text + 1][:, None])
    return lists(hashes[index[inside]].view(np.int64), inside.sum(axis=1))


def fetched(docs: DataFrame, wants: DataFrame) -> DataFrame:
    """kind, side, row, doc_id, word, n, a, b, shift and values of each want; docs has __row. side 2: hashes of all PASSAGE words from word on."""
    joined = docs.select("__row", "doc_id", "text").join(wants.withColumnRenamed("row", "__row"), "__row")
    fields = ("word", "n", "a", "b", "shift")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, asked = batch.column("__row"), batch.column("doc_id").cast(pa.int64()), batch.column("wants")
            for at, to, data, offsets in lower_slices(batch.column("text")):
                words, _ = bare_words(data, offsets)
                hashes = words.hashes()
                part = asked.slice(at, to - at)
                flat, of = part.flatten(), np.repeat(np.arange(to - at), pc.list_value_length(part).to_numpy())
                kind, word, n = (flat.field(k).to_numpy() for k in ("kind", "word", "n"))

                def made(pick: np.ndarray, side: int, values: pa.Array) -> pa.RecordBatch:
                    own, some = pa.array(at + of[pick]), flat.take(pa.array(pick))  # noqa: B023
                    columns = [some.field("kind"), pa.array(np.full(len(pick), side, np.int32)), rows.take(own), ids.take(own), *(some.field(k) for k in fields), values]  # noqa: B023
                    return pa.RecordBatch.from_arrays(columns, names=["kind", "side", "row", "doc_id", *fields, "values"])

                pick = np.flatnonzero(kind == SHINGLES)
                if len(pick):
                    grams = gram_hashes(hashes, SHINGLE)
                    begin = words.first[of[pick]] + word[pick]
                    sets = [np.unique(grams[a : a + k - SHINGLE + 1]).view(np.int64) for a, k in zip(begin.tolist(), n[pick].tolist())]
                    yield made(pick, 0, lists(np.concatenate(sets), np.array([len(x) for x in sets])))
                for side in (0, 1):
                    pick = np.flatnonzero((kind == BESIDE) & (n == side))
                    if len(pick):
                        yield made(pick, side, beside(words, hashes, of[pick], words.first[of[pick]] + word[pick], np.full(len(pick), side)))
                    pick = np.flatnonzero(kind == AROUND)
                    if len(pick):
                        yield made(pick, side, beside(words, hashes, of[pick], words.first[of[pick]] + word[pick] + side * n[pick], np.full(len(pick), side)))
                pick = np.flatnonzero((kind == AROUND) & (n < PASSAGE))
                if len(pick):
                    whole = gram_hashes(hashes, PASSAGE).view(np.int64)
                    low = words.first[of[pick]] + np.maximum(word[pick] - UNIT, 0)
                    high = np.minimum(words.first[of[pick]] + word[pick] + n[pick] + UNIT, words.first[of[pick] + 1]) - PASSAGE + 1
                    count = np.maximum(high - low, 0)
                    yield made(pick, 2, lists(whole[ranges(low, count)[0]], count))
            release()

    return joined.mapInArrow(run, "kind int, side int, row long, doc_id long, word int, n int, a long, b long, shift int, values array<long>")


def grown(found: DataFrame) -> DataFrame:
    """row, word, n, kept_doc_id, kept_word: the spans of PASSAGE words or more among what was fetched of runs."""
    own = found.filter((F.col("kind") == AROUND) & (F.col("side") < 2)).withColumn("at", F.col("word") + F.col("shift") + F.col("side") * F.col("n"))
    there = found.filter(F.col("kind") == BESIDE).select(F.col("row").alias("a"), F.col("word").alias("at"), "side", F.col("values").alias("others"))
    same = F.zip_with("values", "others", lambda x, y: F.coalesce(x == y, F.lit(False)))
    equal = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0).cast("long")) - 1, F.size(same).cast("long")).cast("int")
    sides = own.join(there, ["a", "at", "side"]).select("row", "word", "n", "a", "b", "shift", "side", equal.alias("more"))
    both = sides.groupBy("row", "word", "n", "a", "b", "shift").agg(F.max(F.when(F.col("side") == 0, F.col("more"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("more"))).alias("right"))
    both = materialise(both.withColumn("long", F.col("left") + F.col("n") + F.col("right") >= PASSAGE), "grown")
    long = both.filter("long").select("row", (F.col("word") - F.col("left")).alias("word"), (F.col("left") + F.col("n") + F.col("right")).alias("n"), F.col("b").alias("kept_doc_id"), (F.col("word") - F.col("left") + F.col("shift")).alias("kept_word"))
    # Those too short with their first occurrence may be longer with one another.
    again = found.filter((F.col("kind") == AROUND) & (F.col("side") == 2)).join(both.filter("not long").select("row", "word", "a", "shift"), ["row", "word", "a", "shift"])
    start = F.greatest(F.col("word") - UNIT, F.lit(0))
    windows = materialise(again.select("row", "doc_id", start.alias("start"), F.posexplode("values").alias("k", "window")).select("row", "doc_id", (F.col("start") + F.col("k")).alias("word"), "window").distinct(), "windows")
    firsts = windows.groupBy("window").agg(F.min(place()).alias("kept"), F.min("row").alias("a"), F.max("row").alias("b")).filter("a != b").select("window", "kept")
    more = windows.join(materialise(firsts, "firsts"), "window").filter(F.col("row") != F.col("kept.row")).select("row", "word", F.lit(PASSAGE).alias("n"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.word").alias("kept_word"))
    return long.union(more)


def finer(sets: DataFrame) -> DataFrame:
    """name, bands, sketch, size of sets (name, grams): the finer bands, SKETCH_BITS bits and the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                grams = part.column("grams")
                bounds = grams.offsets.to_numpy() - grams.offsets[0].as_py()
                bands, sketch = band_hashes(grams.flatten().to_numpy().view(np.uint64), bounds, FINE_BANDS, FINE_ROWS, 1, SKETCH_BITS)
                every = [lists(x.ravel(), np.full(len(x), x.shape[1])) for x in (bands, sketch)]
                yield pa.RecordBatch.from_arrays([part.column("name"), *every, pa.array(np.diff(bounds), pa.int32())], names=["name", "bands", "sketch", "size"])

    return sets.select("name", "grams").mapInArrow(run, "name long, bands array<long>, sketch array<long>, size int")


def alike(a: str, b: str) -> Column:
    """Whether two sketches and sizes leave a similarity of SIMILAR likely; of pairs that have it, one in a thousand fails."""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    sizes = F.least(f"{a}.size", f"{b}.size") >= SIMILAR * F.greatest(f"{a}.size", f"{b}.size")
    return sizes & (differ <= SKETCH_MOST)


def similar(a: Column, b: Column) -> Column:
    """Whether the exact similarity of two sets of shingles is SIMILAR at least."""
    both = F.size(F.array_intersect(a, b))
    return both >= SIMILAR * (F.size(a) + F.size(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar."""
    a = sets.select(F.col("name").alias("u"), F.col("grams").alias("ga"))
    b = sets.select(F.col("name").alias("v"), F.col("grams").alias("gb"))
    return pairs.join(a, "u").join(b, "v").filter(similar(F.col("ga"), F.col("gb"))).select("u", "v")


def met_in(rows: DataFrame, name: str) -> DataFrame:
    """Of rows (name, band): those in buckets of several names, with head, the representative, and many, whether there are more than two.

    The order of names differs from band to band, and with it the representative.
    """
    mark = F.col("name").bitwiseXOR(F.col("band"))
    buckets = rows.withColumn("mark", mark).groupBy("band").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low != high")
    buckets = materialise(buckets.select("band", "low", "high"), f"{name}-buckets")
    met = rows.join(buckets, "band").withColumn("mark", mark).select("name", "band", F.col("low").bitwiseXOR(F.col("band")).alias("head"), ((F.col("mark") != F.col("low")) & (F.col("mark") != F.col("high"))).alias("third"))
    out = materialise(met.distinct(), name)
    discard(buckets)
    return out


def star(members: DataFrame) -> DataFrame:
    """u, v: each member with its bucket's representative."""
    return members.filter("name != head").select(F.least("name", "head").alias("u"), F.greatest("name", "head").alias("v")).distinct()


def apart(members: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """band, name, root of the members of buckets of three or more that hold several components."""
    many = members.filter("third").select("band").distinct()
    placed = members.join(many, "band", "left_semi").select("band", "name").join(roots.select(F.col("node").alias("name"), "root"), "name", "left")
    placed = materialise(placed.select("band", "name", F.coalesce("root", "name").alias("root")), f"{name}-placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("band")
    out = materialise(placed.join(mixed, "band"), name)
    discard(placed)
    return out


def clusters(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root of the paragraphs that are linked to others; sets (name, grams) of all members."""
    links = [materialise(verified(star(members), sets), "links")]
    let_go(sets.sparkSession)
    roots = connected_components(links[0])
    mixed = apart(members, roots, "mixed")
    again = materialise(mixed.select("name").distinct(), "again")
    old = [mixed, again]
    if not again.isEmpty():
        fine = materialise(finer(sets.join(again, "name", "left_semi")), "fine")
        close = met_in(fine.select("name", F.explode("bands").alias("band")), "close")
        let_go(sets.sparkSession)
        links.append(materialise(verified(star(close), sets), "links"))
        let_go(sets.sparkSession)
        roots = connected_components(links[0].union(links[1]))
        rest = apart(close, roots, "rest")
        close_by = materialise(rest.join(fine.select("name", "sketch", "size"), "name").join(sets, "name"), "rest")
        a, b = close_by.alias("a"), close_by.alias("b")
        # Pairs are verified within the join: only links come out of it.
        pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.root") < F.col("b.root")) & alike("a", "b") & similar(F.col("a.grams"), F.col("b.grams")))
        links.append(materialise(pairs.select(F.least("a.name", "b.name").alias("u"), F.greatest("a.name", "b.name").alias("v")).distinct(), "links"))
        if not links[2].isEmpty():
            roots = connected_components(links[0].union(links[1]).union(links[2]))
        old += [fine, close, rest, close_by]
    roots = materialise(roots, "roots")
    discard(*links, *old)
    let_go(sets.sparkSession)
    return roots


def repeats(docs: DataFrame) -> DataFrame:
    """row, spans (word, n, kept_doc_id, kept_word): the stretches of words to be cut from each row that has any. docs has __row."""
    found = materialise(pieces(docs), "pieces")
    run_rows = runs(found.filter("bands is null").select("row", "doc_id", "word", "name", "key"))
    # Units are most of the pieces, and only runs() reads them.
    lines = materialise(found.filter("bands is not null").select("row", "doc_id", "word", "n", "name", "key", "bands"), "lines")
    discard(found)
    let_go(docs.sparkSession)
    members = met_in(lines.select("name", F.explode("bands").alias("band")), "members")
    unique = lines.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "word", "n")).alias("first"), F.min("key").alias("a"), F.max("key").alias("b")).filter("a = b")
    unique = materialise(unique.select("name", "first"), "names")
    let_go(docs.sparkSession)
    wanted = members.select("name").distinct().join(unique, "name").select(F.col("first.row").alias("row"), F.col("first.word").alias("word"), F.col("first.n").alias("n"), "name")
    got = materialise(fetched(docs, requests(run_rows, wanted)), "fetched")
    discard(run_rows)
    let_go(docs.sparkSession)
    spans = grown(got)
    let_go(docs.sparkSession)
    roots = clusters(members, got.filter(F.col("kind") == SHINGLES).select(F.col("a").alias("name"), F.col("values").alias("grams")))
    grouped = materialise(unique.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name")), "grouped")
    kept = grouped.join(grouped.groupBy("root").agg(F.min("first").alias("kept")), "root").select("name", "kept")
    cut = lines.select("row", "word", "n", "name").join(kept, "name").filter((F.col("row") != F.col("kept.row")) | (F.col("word") != F.col("kept.word")))
    cut = cut.select("row", "word", "n", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.word").alias("kept_word"))
    out = materialise(spans.union(cut).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("word", "n", "kept_doc_id", "kept_word"))).cast(SPANS).alias("spans")), "cuts")
    discard(lines, members, unique, got, roots, grouped)
    let_go(docs.sparkSession)
    return out


SPANS = "array<struct<word:int,n:int,kept_doc_id:long,kept_word:int>>"


def rid_of(text: bytes, begin: list[int], count: list[int]) -> bytes:
    """The text without the words from each begin on; lines that lose all their words go."""
    data = np.frombuffer(text, np.uint8)
    words = words_of(data, np.array([0, len(data)]), lower=False)
    ink = np.concatenate([[0], np.cumsum(~PUNCTUATION[data])])
    # The words that are counted have something besides punctuation.
    own = np.flatnonzero(ink[words.ends] > ink[words.starts])
    cut = np.zeros(len(own) + 1, np.int64)
    np.add.at(cut, begin, 1)
    np.add.at(cut, np.add(begin, count), -1)
    cut = np.cumsum(cut[:-1]) > 0
    breaks = np.flatnonzero(data == 10)
    stay, after = np.ones(len(data) + 1, bool), np.append(words.starts, len(data))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2] - 1):
        # To the next word, but not beyond the end of the last word's line.
        to, end = after[own[b] + 1], np.searchsorted(breaks, words.ends[own[b]])
        stay[words.starts[own[a]] : min(to, breaks[end]) if end < len(breaks) else to] = False
    stay[breaks] = True
    touched = set(np.searchsorted(breaks, words.starts[own[cut]]).tolist())
    begins, stops, kept = np.concatenate([[0], breaks + 1]), np.append(breaks, len(data)), []
    for k, (a, b) in enumerate(zip(begins.tolist(), stops.tolist())):
        piece = data[a:b]
        if k in touched:
            piece = piece[stay[a:b]]
            if not (~IS_SPACE[piece] & ~PUNCTUATION[piece]).any():
                continue
        kept.append(piece.tobytes())
    return b"\n".join(kept)


def without_repeats(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """docs with text rid of its repeats, and in a column named spans the stretches of words cut, null if there are none."""
    row = free_name([*docs.columns, spans], "__row")
    marked = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = repeats(marked.select("doc_id", "text", F.col(row).alias("__row")))
    joined = marked.join(found.select(F.col("row").alias(row), F.col("spans").alias(spans)), row, "left").drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, len(b), 1024)):
            column = batch.schema.get_field_index("text")
            cut, texts = batch.column(batch.schema.get_field_index(spans)), batch.column(column)
            hit = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                new = []
                for k in hit.tolist():
                    own = cut[k].values
                    new.append(rid_of(texts[k].as_py().encode(), own.field("word").to_pylist(), own.field("n").to_pylist()).decode())
                mask = np.zeros(len(batch), bool)
                mask[hit] = True
                batch = batch.set_column(column, batch.schema.field(column), pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type)))
            yield batch
        release()

    return joined.mapInArrow(run, joined.schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without their repeated paragraphs; n_chars, if it is there, counts what stays."""
    return recounted(without_repeats(docs, free_name(docs.columns, "spans")).select(*docs.columns))


def recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it is there, as the length of text."""
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_cut, spans (words cut, without punctuation, from 0, and where they stay) and the text that stays, of every row."""
    rows = without_repeats(docs.select("doc_id", "text"))
    spans = F.coalesce("spans", F.expr(f"cast(array() as {SPANS})"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(spans).cast("long").alias("n_cut"), spans.alias("spans"), "text")
