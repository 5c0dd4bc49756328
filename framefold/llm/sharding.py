"""Sharding by fixed virtual slots.

A record's hash names one of SLOTS virtual slots for good. The bytes of each
slot are summed, and a versioned map, a table of SLOTS rows whatever the
input, gives each slot a shard: slots by falling bytes, each to the shard with
the fewest bytes so far. A rebalancing edits the map, never the hash.

Defined cases: null text counts as empty; null ids hash with their text;
whole equal rows share a slot; extra columns are dropped from the report; an
empty table gives an empty report and a map of empty slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import exists, materialise, new_path

SLOTS = 8192


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: all that sharding needs of a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows for every slot, empty ones included."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def assign(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """The slot map: version, virtual_slot, shard. One row of the constant number of slots is folded."""
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.expr("cast(array() as array<int>)").alias("to"))

    def place(so_far, slot):
        at = F.array_position(so_far["load"], F.array_min(so_far["load"])).cast("int") - 1
        load = F.transform(so_far["load"], lambda v, i: F.when(i == at, v - slot["less"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(so_far["to"], F.array(at)).alias("to"))

    folded = sizes.agg(by_size.alias("slots")).select("slots", F.aggregate("slots", start, place, lambda s: s["to"]).alias("to"))
    pairs = folded.select(F.explode(F.arrays_zip(F.col("slots.virtual_slot").alias("virtual_slot"), F.col("to").alias("shard"))).alias("p"))
    return pairs.select(F.lit(version).alias("version"), "p.virtual_slot", "p.shard")


def grow(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """The next version of a map, for one more shard, which takes slots from each old shard and gives none."""
    shards = slot_map.agg(F.max("shard") + 1).first()[0]
    per = Window.partitionBy("shard")
    rows = slot_map.join(sizes, "virtual_slot").withColumn("total", F.sum("bytes").over(per))
    taken = F.sum("bytes").over(per.orderBy(F.xxhash64("virtual_slot"), "virtual_slot")) * (shards + 1) <= F.col("total")
    return rows.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(taken & (F.col("bytes") > 0), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Put a version into the store, in a folder of its own: written again it is the same, and earlier versions stay readable."""
    slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the store, the latest by default."""
    rows = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    version = version or rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == version).select("version", "virtual_slot", "shard")


def shard_report(docs: DataFrame, shards: int = 8, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Each row's shard under the law of near-equal bytes, its gapless place in that shard, and the version of the map.

    The map goes into the store as its next version (1 in a new store) and is read back from there.

    Places are numbered within each virtual slot, which hashing keeps small,
    and start where the shard's earlier slots end.
    """
    rows = materialise(slotted(docs, slots), "slotted")
    sizes = slot_sizes(rows, slots)
    known = store is not None and exists(docs.sparkSession, store)
    store = store or new_path(docs.sparkSession, "slot-map")
    version = load_map(docs.sparkSession, store).first().version + 1 if known else 1
    save_map(assign(sizes, shards, version), store, version)
    slot_map = load_map(docs.sparkSession, store, version).join(sizes, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    # slots rows, a constant: safe to broadcast at any input size.
    placed = rows.join(F.broadcast(starts.select("virtual_slot", "version", "shard", "start")), "virtual_slot")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.row_number().over(within) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version",
    )
