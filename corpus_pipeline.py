"""The corpus pipeline: each stage's rows are written as Parquet and reread as the next stage's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from framefold.llm import decontaminate, packing, quality_rules, simhash, storage, substring_dedup


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stages before have made.
MADE: list[DataFrame] = []


def stage(run: Stage) -> Stage:
    """run, which first deletes the tables of earlier stages: what they return is written by then. Those that docs reads itself stay."""

    @wraps(run)
    def cleared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.discard_all_but(MADE, docs)
        storage.let_go(spark)
        with storage.recorded(MADE):
            return run(spark, docs, sf_dir)

    return cleared


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep, unchanged.

    Null and wordless texts, and all of fewer than 50 words, are rejected. Null lang and source are groups of their own; repeated rows
    are judged alike; columns of any name are kept; an empty table gives no rows. Texts of any length are measured whole.
    """
    return quality_rules.kept_documents(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the least doc_id, null ids last.

    Null and wordless texts have fingerprint 0 and are one component with others near it; of equal rows one stays; columns of any name are
    kept; an empty table gives no rows.
    """
    return simhash.one_of_each(docs)


@stage
def paragraph_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated paragraphs; n_chars counts what stays.

    Every row stays, also if it loses all of its text. Null texts stay null; of equal rows one keeps its text; null ids come last; columns
    of any name are kept; an empty table gives no rows.
    """
    return substring_dedup.deduplicated(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and wordless texts are clean; equal rows are judged alike; null ids of documents and items are like others; columns of any name are
    kept; an empty benchmark leaves all, an empty table gives no rows.
    """
    return decontaminate.clean(docs, storage.table(spark, sf_dir, "benchmark"))


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens, with their ids.

    A null or empty text is its end id alone; equal rows are packed each on their own; null ids stay null; other columns are left out; an
    empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", paragraph_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", sequences),
]

#: Stages after the first have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage's table goes when the next but one begins."""
    docs, held = storage.table(spark, sf_dir, "documents"), []
    for name, stage_ in STAGES[:-1]:
        made = storage.materialise(stage_(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
        storage.discard(*held)
        docs, held = made, [made]
    return STAGES[-1][1](spark, docs, sf_dir)
