"""Unbounded sources of chunks (stream_id, seq, data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHUNK


def from_folder(spark: SparkSession, path: str, form: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Chunks from files as they come; files_per_trigger throttles."""
    reader = spark.readStream.schema(CHUNK).format(form)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def from_kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """Chunks from a topic: its key is the stream, its offset the order. The connector's jar must be on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    rows = (reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader).load()
    return rows.select(F.col("key").cast("string").alias("stream_id"), F.col("offset").alias("seq"), F.col("value").alias("data"))


def from_messages(messages: DataFrame) -> DataFrame:
    """Control and audio messages (client_id, seq, text, data) as session rows: text is JSON.

    A client_id 'new' gets an id that all messages of its connection share: that of the column connection, which names
    the connection wherever clients are new; without one it is an error.

    kind is start, stop or data; config is what a start brings.
    """
    schema = "type string, config struct<vad_threshold:double,speech_pad_ms:int,min_silence_duration_ms:int,sample_rate:int>"
    said = F.from_json("text", schema)
    connection = F.col("connection").cast("string") if "connection" in messages.columns else F.raise_error(F.lit("a new client needs a connection")).cast("string")
    stream = F.when(F.col("client_id") == "new", F.concat(F.lit("new-"), F.substring(F.sha2(connection, 256), 1, 16))).otherwise(F.col("client_id"))
    return messages.select(stream.alias("stream_id"), "seq", F.when(F.col("text").isNotNull(), said["type"]).otherwise("data").alias("kind"), said["config"].alias("config"), "data")
