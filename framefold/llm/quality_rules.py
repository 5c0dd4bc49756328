"""Quality rules with thresholds that adapt to each language and source.

Each document is measured by Spark expressions alone. The measures, in
thousandths, go into histogram sketches: counts by bucket, exact below 1024
and with 10 significant bits above. Such sketches merge by adding counts, so
the sums are combined before they are shuffled and one source that holds a
third of all rows costs no more than others. From the sketch of a (lang,
source) group come its quartiles, and from those its outer fences. A group of
fewer than MIN_GROUP rows takes the fences of its language, and a language
that small those of all rows.

Defined cases: null text has no words and fails the base rules; null lang and
null source are groups of their own; repeated rows are judged alike; extra
columns are kept, unless they bear the name of a measure, which replaces them;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MIN_GROUP = 100
#: Measure: its least spread in thousandths. A fence lies REACH spreads beyond a quartile.
SPREAD = {"mean_length": 400, "symbols": 50, "repeats": 100, "dup_lines": 100}
REACH = 3
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that occur at least twice in the text."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.try_element_at(starts, k + 2) - p))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + F.coalesce(g, F.lit(3)))

    def counted(hashes: Column) -> Column:
        # A position in the low bits of each hash: one sort of plain longs brings equal windows together.
        bits = F.length(F.bin(F.size(words).cast("long")))
        mask = F.expr("1L").cast("long")

        def sorted_keys(low: Column) -> Column:
            keys = F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))

            def starts(keys: Column) -> Column:
                def same(a: Column, b: Column) -> Column:
                    pa, pb = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
                    alike = reduce(lambda x, y: x & y, [words[pa + k] == words[pb + k] for k in range(3)])
                    return (a.bitwiseXOR(b) <= low) & (a.bitwiseXOR(b) >= 0) & alike

                twice = F.filter(
                    keys,
                    lambda x, j: F.coalesce((j > 0) & same(F.try_element_at(keys, F.greatest(j, F.lit(1))), x), F.lit(False))
                    | F.coalesce(same(x, F.try_element_at(keys, j + 2)), F.lit(False)),
                )
                return F.array_sort(F.transform(twice, lambda x: x.bitwiseAND(low).cast("int")))

            return let(let(F.sort_array(keys), starts), covered)

        low = F.call_function("shiftleft", mask, bits) - F.lit(1).cast("long")
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(low, sorted_keys))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, counted)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns of MEASURES; one pass over the text, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn("__words", F.array_remove(F.split(text, SPACE), "")).withColumn("__lines", lines)
    words = F.col("__words")
    docs = docs.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(words),
        }
    ).drop("__words", "__lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def scaled() -> dict[str, Column]:
    """The measures in whole thousandths."""
    ratio = lambda a, b: F.expr(f"(1000 * {a}) div greatest({b}, 1)")
    return {
        "mean_length": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "n_words"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
    }


def bucket(value: str) -> Column:
    """Lower end of the bucket: the value's 10 leading bits."""
    return F.expr(f"shiftleft(shiftright({value}, greatest(length(bin({value})) - 10, 0)), greatest(length(bin({value})) - 10, 0))")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the mergeable sketch of every (lang, source) group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in scaled().items()]))
    return rows.filter(~F.col("base_failed")).select("lang", "source", pairs.alias("m")).select("lang", "source", "m.measure", "m.value").groupBy("lang", "source", "measure", bucket("value").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and low_/high_ of each measure, of every group in the sketch."""

    def quartiles(level: list[str]) -> DataFrame:
        merged = sketch.groupBy(*level, "measure", "bucket").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*level, "measure")
        seen = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
        first = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
        return seen.groupBy(*level, "measure").agg(first(1).alias("q1"), first(3).alias("q3"), F.max("total").alias("total"))

    def named(level: list[str], tag: str) -> DataFrame:
        fit = quartiles(level)
        return fit.select(*[F.col(c).alias(f"{c}_{tag}") for c in level], F.col("measure").alias(f"measure_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in ("q1", "q3", "total")])

    own, lang, all_ = named(["lang", "source"], "own"), named(["lang"], "lang"), named([], "all")
    fit = own.join(lang, (F.col("measure_own") == F.col("measure_lang")) & F.col("lang_own").eqNullSafe(F.col("lang_lang"))).join(all_, F.col("measure_own") == F.col("measure_all"))

    def pick(c: str) -> Column:
        return F.when(F.col("total_own") >= MIN_GROUP, F.col(f"{c}_own")).when(F.col("total_lang") >= MIN_GROUP, F.col(f"{c}_lang")).otherwise(F.col(f"{c}_all"))

    least = F.create_map(*[x for k, v in SPREAD.items() for x in (F.lit(k), F.lit(v))])[F.col("measure_own")]
    fit = fit.select(F.col("lang_own").alias("lang"), F.col("source_own").alias("source"), F.col("measure_own").alias("measure"), pick("q1").alias("q1"), pick("q3").alias("q3"), least.alias("least"))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    return fit.groupBy("lang", "source").agg(*[of(m, F.col("q3") + reach).alias(f"high_{m}") for m in SPREAD], of("mean_length", F.col("q1") - reach).alias("low_mean_length"))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with kept: a joined filter on the fences of the row's group."""
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in limits.columns[2:]])
    rows = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    value = scaled()
    inside = reduce(lambda a, b: a & b, [value[m] <= F.col(f"__high_{m}") for m in SPREAD] + [value["mean_length"] >= F.col("__low_mean_length")])
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(*limits.columns)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, unchanged. Rows are written with their measures, so each text is measured once."""
    rows = materialise(measured(docs.select(F.struct(*docs.columns).alias("document"), "lang", "source", "text")).drop("text"), "measures")
    limits = materialise(fences(sketches(rows)), "fences")
    return judged(rows, limits).filter("kept").select("document.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and kept of every row: texts are measured once, the measures written and judged."""
    rows = materialise(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "measures")
    return judged(rows, fences(sketches(rows))).select("doc_id", *MEASURES, "kept")
