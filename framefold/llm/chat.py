r"""Chat formatting by relational expressions alone.

Turns are grouped by conversation, sorted as structs, adjacent turns of one
role merged by an array aggregation, and concatenated. The template:

    ### <role>:\n<text>[</turn><text>...]</turn>\n   for each block of one role

Beside the text goes its loss mask as runs, which alternate between what bears
no loss and a turn's text; a run says how many characters it has and whether
they bear loss, as those of the assistant do. Inside texts and roles a backslash becomes `\\`, `#` becomes `\h` and `<`
becomes `\l` (in a role also a line end `\n`), so an escaped text holds no `#`
and no `<`, hence no control string, and a reader undoes it without loss. Merged turns keep their bounds as `</turn>`.

Defined cases: null text and null role are empty; a null turn sorts first and
a null conv_id is a conversation; equal turn numbers sort by role, then text;
repeated rows are repeated turns; extra columns are ignored; an empty table
gives no rows. A conversation is one value, however long, as its text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END, OPEN = "</turn>", "### "
SAMPLE = r"\### Assistant: </turn> ok"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    r"""Undoes escape: pairs of backslashes part the text, so what follows another backslash is plain."""
    parts = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def sample(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(SAMPLE).alias("text"))


def begins(turns: Column, i: Column) -> Column:
    """Whether turn i is the first of its role's block."""
    return (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"])


def merged(turns: Column) -> Column:
    """Blocks of adjacent turns with one role: role, body (texts joined by END). Bounds first, then one slice for each block."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: begins(turns, i))

    def cut(starts: Column) -> Column:
        def block(i: Column, k: Column) -> Column:
            end = F.coalesce(F.try_element_at(starts, k + 2), n)
            texts = F.transform(F.slice(turns, i + 1, end - i), lambda t: t["text"])
            return F.struct(turns[i]["role"].alias("role"), F.array_join(texts, END).alias("body"))

        return F.transform(starts, block)

    return F.transform(F.array(starts), cut)[0]


def loss_runs(turns: Column) -> Column:
    """length and loss of runs of characters: two for each turn, what stands before its text and the text; at last what closes."""

    def two(t: Column, i: Column) -> Column:
        first = begins(turns, i)
        before = F.when(first, F.length(t["role"]) + len(OPEN) + 2).otherwise(0) + F.when(i == 0, 0).otherwise(F.when(first, len(END) + 1).otherwise(len(END)))
        run = lambda n, loss: F.struct(n.cast("int").alias("length"), loss.alias("loss"))
        return F.array(run(before, F.lit(False)), run(F.length(t["text"]), t["role"] == LOSS_ROLE))

    close = F.array(F.struct(F.lit(len(END) + 1).alias("length"), F.lit(False).alias("loss")))
    return F.concat(F.flatten(F.transform(turns, two)), close)


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (one text for each conversation) and loss (its mask, see loss_runs)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    # Sorted as plain texts; escapes would order them otherwise.
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("plain"))
    turns = F.transform("plain", lambda t: F.struct(F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")).alias("role"), escape(t["text"]).alias("text")))
    rows = rows.select("conv_id", turns.alias("turns"))
    whole = F.array_join(F.transform(merged(F.col("turns")), lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(":\n"), b["body"], F.lit(END + "\n"))), "")
    return rows.select("conv_id", whole.alias("formatted"), loss_runs(F.col("turns")).alias("loss"))


def parsed(texts: DataFrame) -> DataFrame:
    """texts with turns array<struct<role, text, length>>, read back from formatted; length is that of the escaped text; escapes leave bounds unmistakable."""

    def turns(block: Column) -> Column:
        role = F.substring_index(block, ":\n", 1)
        texts = F.split(F.substring(block, F.length(role) + 3, F.length(block)), END, -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text"), F.length(t).alias("length")))

    closed = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(END) + 1})")
    blocks = F.split(closed, rf"</turn>\n{OPEN}", -1)
    return texts.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def under_loss(turns: Column, loss: Column) -> Column:
    """The turns whose text the mask marks; null if its runs do not fall on the texts."""
    fits = F.forall(F.transform(turns, lambda t, i: t["length"] == F.try_element_at(loss, 2 * i + 2)["length"]), lambda x: x)
    return F.when(fits, F.filter(turns, lambda t, i: F.try_element_at(loss, 2 * i + 2)["loss"]))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digests of every conversation as read back from its formatted text and loss mask."""
    rows = parsed(formatted(conversations.select("conv_id", "turn", "role", "text")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(under_loss(F.col("turns"), F.col("loss")), lambda t: t["text"]), "")
    rows = rows.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), lines.alias("lines"), loss.alias("loss"))
    return rows.select("conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
