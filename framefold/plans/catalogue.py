"""The queries over the test tables and their equivalents in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..functions import codecs, text
from ..operators import framing, scoring, segments, stats, validate

START, END = 60.0, 35.0
#: Sample size for each unit of an event's value.
LOUDNESS = 65
#: Ids that one task puts in order.
RUN_OF_IDS = 16384
KEY = ["stream_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: a stream for each user, a frame for each event, marked by its value."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", "event_type", F.col("value").alias("score"))
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")).cast("long")
    rows = rows.withColumn("frame_id", number).withColumn("timestamp_ms", framing.timestamp(F.col("frame_id")))
    return rows.withColumn("marker", scoring.threshold_marker(F.col("score"), START, END))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_roles(event_frames(spark, sf_dir), KEY)


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(roles(spark, sf_dir), KEY)


def segment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed(spark, sf_dir).select("stream_id", "segment_id", "start_timestamp_ms", "end_timestamp_ms", "frame_count", "duration_ms")


def frame_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles(spark, sf_dir).filter("role = 'frame'").select("stream_id", "frame_id", "timestamp_ms")


def results_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles(spark, sf_dir)
    null = F.lit(None)
    single = rows.filter("role = 'frame'").select("stream_id", F.lit("frame").alias("result_type"), "frame_id", null.cast("long").alias("segment_id"), null.cast("double").alias("duration_ms"), F.lit(segments.INSTANCE).alias("instance_id"))
    whole = segments.segments(rows, KEY).select("stream_id", F.lit("segment").alias("result_type"), null.cast("long").alias("frame_id"), "segment_id", "duration_ms", F.lit(segments.INSTANCE).alias("instance_id"))
    return single.union(whole)


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles(spark, sf_dir).groupBy("role").agg(F.count("*").alias("frames"), F.count_distinct("stream_id").alias("streams"))


def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles(spark, sf_dir).filter("role = 'drop'").select("stream_id", "frame_id", "marker")


def open_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.open_segments(roles(spark, sf_dir), KEY)


def hysteresis_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_frames(spark, sf_dir).withColumn("score", F.least(F.col("score") / 100, F.lit(1.0)))
    return scoring.hysteresis_markers(rows, "stream_id", "frame_id", "score", 0.5, 0.15, 3)


def hysteresis_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hysteresis_frames(spark, sf_dir).filter("marker is not null").select("stream_id", "frame_id", "marker")


def hysteresis_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.with_roles(hysteresis_frames(spark, sf_dir), KEY)
    return segments.segments(rows, KEY).select("stream_id", "segment_id", "first_frame", "last_frame", "frame_count")


def processor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles(spark, sf_dir)
    made = rows.filter("role = 'frame'").select("stream_id", F.lit("frame").alias("result_type")).union(segments.segments(rows, KEY).select("stream_id", F.lit("segment")))
    pushed = event_frames(spark, sf_dir).select("stream_id", F.round("score", 0).alias("processing_time_ms"), (F.col("event_type") == "error").alias("error"))
    found = stats.processor_stats(made, pushed, KEY)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.latency(table(spark, sf_dir, "events"), "value", ["event_type"], exact=True)
    return found.select("event_type", "success_count", *[F.round(c, 6).alias(c) for c in ("avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "max_latency_ms")])


def last_n_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.last_n(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value", 100, F.date_format("ts", "yyyyMMddHH"))
    return rows.select("event_id", F.round("ring_mean", 9).alias("ring_mean"), "ring_max", "ring_size")


def best_worst_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("cost"), F.count("*").alias("gain"))
    return stats.extremes(per, "event_type", "cost", "gain")


def spread_and_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    wide = stats.spread("value")
    per = rows.groupBy("event_type").agg(F.round(wide["spread"], 6).alias("spread"), wide["is_even"].alias("is_even"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"))
    return per.withColumn("grade", stats.grade(F.col("n") / 10.0, F.col("mean_ms")))


def isolation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(stats.all_distinct("event_id").alias("distinct_events"), F.count_distinct("user_id").alias("streams"))


def concurrency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = roles(spark, sf_dir).groupBy("stream_id").agg(F.count_if(F.col("role") == "frame").alias("frames"))
    return stats.rollup(per.withColumn("group_id", F.col("stream_id") % 7), ["group_id"], "frames").select("group_id", "total_frames", "active_streams", F.round("success_rate", 6).alias("success_rate"), F.round("mean_frames", 6).alias("mean_frames"))


def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.every_nth(table(spark, sf_dir, "events"), 50, ["event_type"], "event_id", F.expr(f"event_id div {RUN_OF_IDS}")).select("event_type", "event_id")


def health_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = stats.latency(table(spark, sf_dir, "events"), "value", ["user_id"], exact=True)
    ok = stats.success(F.col("success_count"), F.pmod("user_id", F.lit(3)))
    rows = per.select("user_id", ok["total_operations"].alias("total_operations"), F.round(ok["success_rate"], 6).alias("success_rate"), "p99_latency_ms")
    return rows.select("user_id", "total_operations", "success_rate", stats.healthy(1 - F.col("success_rate"), F.col("total_operations") / 60, F.col("p99_latency_ms"), 0.05, 1.0, 200.0).alias("is_healthy"))


def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("data"))


def digest(data: Column) -> Column:
    return F.md5(F.hex(data).cast("binary"))


def frame_align_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Chunks of 700 bytes, as a stream brings them: frames do not depend on them.
    rows = document_bytes(spark, sf_dir)
    parts = F.posexplode(F.transform(codecs.indices(F.ceil(F.length("data") / 700)), lambda i: F.substring("data", i * 700 + 1, F.lit(700))))
    chunks = rows.select("stream_id", parts.alias("seq", "data"))
    return framing.aligned(chunks).select("stream_id", "frame_id", "timestamp_ms", digest(F.col("audio_data")).alias("digest"))


def frame_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_bytes(spark, sf_dir)
    return rows.select("stream_id", *[v.cast("double" if k == "usage_ratio" else "long").alias(k) for k, v in framing.gauges(F.col("data"), cap=8000).items()])


def overflow_keep_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_bytes(spark, sf_dir).withColumn("kept", framing.kept_tail(F.col("data"), 8000))
    return rows.select("stream_id", F.length("kept").cast("long").alias("kept_bytes"), F.size(framing.frames_of(F.col("kept"))).cast("long").alias("frames"), digest(F.col("kept")).alias("digest"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def hop_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(framing.hops(F.col("embedding"), 16, 4)).alias("hop", "part"))
    return rows.select("vec_id", F.col("hop").cast("long").alias("hop"), F.size("part").cast("long").alias("samples"), F.round(F.aggregate("part", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


def pcm16_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_bytes(spark, sf_dir).select("stream_id", codecs.pcm16_to_float(F.col("data")).alias("a"))
    return rows.select("stream_id", F.size("a").cast("long").alias("samples"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pushes of 1024 bytes: a stream for each user, and 512 samples of one size, which the event's value sets."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", F.floor(F.col("value") * LOUDNESS).cast("int").alias("size"))
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")).cast("long") - 1
    return rows.select("stream_id", number.alias("seq"), F.unhex(F.repeat(F.format_string("%02X%02X", F.col("size") % 256, F.shiftright("size", 8)), 512)).alias("data"))


def byte_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from bytes to results, audio included."""
    from ..api import Engine

    with Engine(spark) as engine:
        found = engine.from_chunks(event_chunks(spark, sf_dir))
    one, many = F.col("frame"), F.col("segment")
    return found.select(
        "stream_id", "result_type", one["frame_id"].alias("frame_id"), many["segment_id"].alias("segment_id"), F.coalesce(one["timestamp_ms"], many["start_timestamp_ms"]).alias("start_ms"),
        F.coalesce(one["timestamp_ms"], many["end_timestamp_ms"]).alias("end_ms"), F.coalesce(many["frame_count"].cast("long"), F.lit(1).cast("long")).alias("frames"), digest(F.coalesce(one["audio_data"], many["audio_data"])).alias("digest"),
    )


def float_to_pcm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", codecs.float_to_int16(F.col("embedding")).alias("a"))
    return rows.select("vec_id", F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("a").cast("long").alias("highest"), F.array_min("a").cast("long").alias("lowest"))


def alaw_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(256).select(F.col("id").alias("code"), codecs.alaw_sample(F.col("id")).cast("double").alias("sample"))


def integer_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", codecs.float_to_int16(F.col("embedding")).alias("a"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), 5) + 0.0
    wide = F.transform("a", lambda x: x.cast("int") * 65536)
    return rows.select("vec_id", total(codecs.int16_to_float(F.col("a"))).alias("from_int16"), total(codecs.int32_to_float(wide)).alias("from_int32"), total(codecs.int8_to_float(F.transform("a", lambda x: F.floor(x / 256)))).alias("from_int8"))


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", codecs.resample(F.col("embedding"), 22050, 16000).alias("a"))
    return rows.select("vec_id", F.size("a").cast("long").alias("samples"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


def rms_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(codecs.rms(F.col("embedding")), 6).alias("level"))


def base64_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_bytes(spark, sf_dir).select("stream_id", text.base64_line(F.col("data")).alias("encoded"), (F.unbase64(text.base64_line(F.col("data"))) == F.col("data")).alias("round_trip"))


def format_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = closed(spark, sf_dir)
    return rows.select("stream_id", "segment_id", text.seconds(F.col("start_timestamp_ms")).alias("start_text"), text.segment_file("segment", F.col("segment_id"), F.col("start_timestamp_ms"), F.col("end_timestamp_ms")).alias("file_name"))


def semver_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.format_string("%d.%d.%d", F.col("p_partkey") % 3, F.col("p_size"), F.col("p_partkey") % 10).alias("version"))
    rows = rows.withColumn("version", F.when(F.col("p_partkey") % 4 == 0, F.concat("version", F.lit("-rc.1+b7"))).otherwise(F.col("version")))
    return rows.select("p_partkey", *[text.version_part(F.col("version"), p).alias(p) for p in ("major", "minor", "patch", "pre", "build")], text.version_compatible(F.col("version"), F.lit("1.20.3")).alias("compatible"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars")), ["conv_id"], ["turn"])


def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(F.lit("wav"), F.lit("pcma"), F.lit("mp3")), (F.col("event_id") % 3 + 1).cast("int")).alias("form"), F.element_at(F.array(*map(F.lit, (8000, 16000, 22050, 11025))), (F.col("event_id") % 4 + 1).cast("int")).alias("rate"), (F.col("event_id") % 3).cast("int").alias("channels"), F.floor("value").cast("int").alias("chunk"), (F.col("event_id") % 60).cast("int").alias("overlap"))
    some = F.array(F.lit(0.0))
    return rows.select("event_id", validate.format_ok(F.col("form"), F.col("rate"), F.col("channels")).alias("format_ok"), validate.audio_config_ok(F.col("form"), F.col("rate"), F.col("channels"), F.lit("int16")).alias("config_ok"), validate.chunk_ok(some, F.col("chunk"), F.col("overlap"), F.col("rate")).alias("chunk_ok"), validate.timing_ok(F.col("chunk") * 10, F.col("overlap"), F.lit(100), F.lit(100), F.lit(30)).alias("timing_ok"))


def frame_size_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.chunk_table(spark)


def chunk_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    size = F.floor("value").cast("long") + 1
    return rows.select("event_id", *[(F.round(v, 6) if k != "total_size" else v).alias(k) for k, v in validate.chunk_times(F.col("event_id") * 32.0, size, F.lit(16), F.lit(16000)).items()], validate.confident(F.col("value") / 100).alias("confident"))


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.array(1 - F.col("value") / 500, F.col("value") / 500)).otherwise(F.array(F.col("value") / 500)).alias("out"))
    p = scoring.probability(F.col("out"))
    return rows.select("event_id", *[F.round(v, 9).alias(k) if k == "confidence" else v.alias(k) for k, v in scoring.verdict(p, 0.5).items()])


def longest_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of long streams: line items of a supplier in shipping order, marked by quantity."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber")).cast("long")
    rows = rows.select("stream_id", number.alias("frame_id"), framing.timestamp(number).alias("timestamp_ms"), scoring.threshold_marker(F.col("l_quantity"), 40.0, 12.0).alias("marker"))
    found = segments.segments(segments.with_roles(rows, KEY), KEY)
    return found.groupBy("stream_id").agg(F.count("*").alias("segments"), F.sum("frame_count").alias("frames"), F.max("duration_ms").alias("longest_ms"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the streaming operator: rows come in files in any order and wait until their turn."""
    import tempfile

    from ..streaming import fold

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="framefold-stream-")
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    fold.enable(spark)
    rows = event_frames(spark, sf_dir).select(F.col("stream_id").cast("string").alias("stream_id"), F.col("frame_id").alias("seq"), "marker")
    rows.repartition(4, F.xxhash64("seq")).write.parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    out = fold.run_available(fold.marker_segments(source), f"{root}/out", f"{root}/checkpoint")
    first, last = F.col("first_frame"), F.col("last_frame")
    return out.select(F.col("stream_id").cast("long").alias("stream_id"), "segment_id", framing.timestamp(first).alias("start_timestamp_ms"), framing.timestamp(last).alias("end_timestamp_ms"), "frame_count", framing.timestamp(last - first).alias("duration_ms"))


FRAMES = f"""frames as (select user_id stream_id, event_type, value score, row_number() over (partition by user_id order by ts, event_id) frame_id,
  case when value >= {START} then 'start' when value < {END} then 'end' end marker from events)"""


def roles_sql(frames: str) -> str:
    return f"""{frames}, prior as (select *, coalesce(last_value(marker ignore nulls) over (partition by stream_id order by frame_id rows between unbounded preceding and 1 preceding), 'end') was from frames),
 parts as (select *, case when marker is null and was = 'end' then 'frame' when marker is null then 'mid' when marker = 'start' and was = 'end' then 'open' when marker = 'end' and was = 'start' then 'close' else 'drop' end as role from prior),
 roles as (select *, sum(case when role = 'open' then 1 else 0 end) over (partition by stream_id order by frame_id)::bigint segment_id from parts),
 segs as (select stream_id, segment_id, min(frame_id) first_frame, max(frame_id) last_frame, count(*) frame_count, bool_or(role = 'close') closed from roles where role in ('open', 'mid', 'close') group by all),
 closed as (select * from segs where closed)"""


ROLES = f"with {roles_sql(FRAMES)}"
HYSTERESIS = """raw as (select user_id stream_id, least(value / 100, 1.0e0) score, row_number() over (partition by user_id order by ts, event_id) frame_id from events),
 isl as (select *, sum(case when score >= 0.5 then 1 else 0 end) over (partition by stream_id order by frame_id) island from raw),
 qt as (select *, min(case when score < 0.35e0 and island > 0 then frame_id end) over (partition by stream_id, island) quiet from isl),
 en as (select *, min(case when score < 0.35e0 and frame_id - quiet >= 3 then frame_id end) over (partition by stream_id, island) ending from qt),
 bf as (select *, lag(ending) over (partition by stream_id order by frame_id) lastend from en),
 frames as (select stream_id, frame_id, case when score >= 0.5 and (island = 1 or lastend is not null) then 'start' when frame_id = ending then 'end' end marker from bf)"""
LOUD = HYSTERESIS.replace("value / 100", f"floor(value * {LOUDNESS}) / 32768.0e0 / 0.1e0").replace("quiet >= 3", "quiet >= 4")
SEGMENTS = ROLES + " select stream_id, segment_id, first_frame * 32.0e0 start_timestamp_ms, last_frame * 32.0e0 end_timestamp_ms, frame_count, (last_frame - first_frame) * 32.0e0 duration_ms from closed"
BYTES = "with b as (select doc_id stream_id, encode(text) x, octet_length(encode(text)) n from documents)"
CHUNK_ROWS = ", ".join(f"({r}, {ms}, {n})" for r, ns in framing.CHUNK_SAMPLES.items() for ms, n in zip(framing.CHUNK_MS, ns))
VEC = "select vec_id, list_transform(embedding, lambda x: x::double) a from embeddings"

ORACLE = {
    "segments": SEGMENTS,
    "stream_segments": SEGMENTS,
    "frame_results": ROLES + " select stream_id, frame_id, frame_id * 32.0e0 timestamp_ms from roles where role = 'frame'",
    "results_union": ROLES + " select stream_id, 'frame' result_type, frame_id, null::bigint segment_id, null::double duration_ms, 'stream_processor' instance_id from roles where role = 'frame' union all select stream_id, 'segment', null, segment_id, (last_frame - first_frame) * 32.0e0, 'stream_processor' from closed",
    "role_counts": ROLES + " select role, count(*) frames, count(distinct stream_id) streams from roles group by role",
    "dropped_frames": ROLES + " select stream_id, frame_id, marker from roles where role = 'drop'",
    "open_segments": ROLES + " select stream_id, segment_id, frame_count, first_frame from segs where not closed",
    "hysteresis_markers": f"with {HYSTERESIS} select stream_id, frame_id, marker from frames where marker is not null",
    "hysteresis_segments": f"with {roles_sql(HYSTERESIS)} select stream_id, segment_id, first_frame, last_frame, frame_count from closed",
    "byte_results": f"""with {roles_sql(LOUD)}, size as (select user_id stream_id, floor(value * {LOUDNESS})::int v, row_number() over (partition by user_id order by ts, event_id) frame_id from events),
 heard as (select r.*, repeat(printf('%02X%02X', v % 256, v // 256), 512) h from roles r join size s on r.stream_id = s.stream_id and r.frame_id = s.frame_id)
 select stream_id, 'frame' result_type, frame_id, null::bigint segment_id, frame_id * 32.0e0 start_ms, frame_id * 32.0e0 end_ms, 1::bigint frames, md5(h) digest from heard where role = 'frame' union all
 select h.stream_id, 'segment', null, h.segment_id, min(frame_id) * 32.0e0, max(frame_id) * 32.0e0, count(*), md5(string_agg(h, '' order by frame_id)) from heard h join closed c on h.stream_id = c.stream_id and h.segment_id = c.segment_id where role in ('open', 'mid', 'close') group by h.stream_id, h.segment_id""",
    "processor_stats": ROLES + """, made as (select stream_id, sum((kind = 's')::int)::bigint seg, sum((kind = 'f')::int)::bigint one from (select stream_id, 'f' kind from roles where role = 'frame' union all select stream_id, 's' from closed) group by 1),
 done as (select stream_id, sum((event_type <> 'error')::int)::bigint ok, coalesce(sum(case when event_type <> 'error' then round(score, 0) end), 0.0e0)::double total, sum((event_type = 'error')::int)::bigint err from frames group by 1)
 select d.stream_id, ok total_chunks_processed, round(total, 6) total_processing_time_ms, round(coalesce(total / nullif(ok, 0), 0.0e0), 6) average_processing_time_ms, coalesce(seg, 0)::bigint speech_segments, coalesce(one, 0)::bigint single_frames,
 round(coalesce(coalesce(seg, 0) / nullif(coalesce(seg, 0) + coalesce(one, 0), 0)::double, 0.0e0), 6) speech_ratio, round(coalesce(ok / nullif(total / 1000, 0), 0.0e0), 6) throughput_chunks_per_second, 80.0e0 memory_usage_mb, err error_count, round(coalesce(err / nullif(ok, 0)::double, 0.0e0), 6) error_rate from done d left join made m on d.stream_id = m.stream_id""",
    "latency_percentiles": "select event_type, count(value) success_count, round(avg(value), 6) avg_latency_ms, round(quantile_cont(value, 0.5), 6) p50_latency_ms, round(quantile_cont(value, 0.95), 6) p95_latency_ms, round(quantile_cont(value, 0.99), 6) p99_latency_ms, round(max(value), 6) max_latency_ms from events group by 1",
    "last_n_ring": "select event_id, round(avg(value) over w, 9) ring_mean, max(value) over w ring_max, count(value) over w ring_size from events window w as (partition by event_type order by ts, event_id rows between 99 preceding and current row)",
    "best_worst_key": "with per as (select event_type, round(avg(value), 9) cost, count(*) gain from events group by 1) select (select event_type from per order by cost, event_type limit 1) least_cost, (select event_type from per order by gain desc, event_type limit 1) largest_gain",
    "spread_and_grade": "select *, case when n / 10.0e0 > 100 and mean_ms < 50 then 'excellent' when n / 10.0e0 > 50 and mean_ms < 100 then 'good' when n / 10.0e0 > 20 and mean_ms < 200 then 'fair' else 'poor' end grade from (select event_type, round(max(value) - min(value), 6) spread, max(value) - min(value) < 1000 is_even, count(*) n, round(avg(value), 6) mean_ms from events group by 1)",
    "isolation_check": "select event_type, count(distinct event_id) = count(event_id) distinct_events, count(distinct user_id) streams from events group by 1",
    "concurrency_rollup": ROLES + ", per as (select stream_id, sum((role = 'frame')::int)::bigint frames from roles group by 1) select stream_id % 7 group_id, sum(frames)::bigint total_frames, sum((frames > 0)::int)::bigint active_streams, round(sum((frames > 0)::int) / count(*)::double, 6) success_rate, round(avg(frames), 6) mean_frames from per group by 1",
    "every_nth": "select event_type, event_id from (select *, row_number() over (partition by event_type order by event_id) k from events) where k % 50 = 0",
    "health_flag": "with per as (select user_id, count(value) + user_id % 3 total_operations, round(count(value) / (count(value) + user_id % 3)::double, 6) success_rate, quantile_cont(value, 0.99) p99 from events group by 1) select user_id, total_operations, success_rate, (1 - success_rate <= 0.05e0 and total_operations / 60.0e0 >= 1 and p99 <= 200) is_healthy from per",
    "frame_align_bytes": BYTES + ", f as (select stream_id, x, unnest(range(n // 1024)) i from b) select stream_id, i + 1 frame_id, (i + 1) * 32.0e0 timestamp_ms, md5(hex(array_slice(x, i * 1024 + 1, i * 1024 + 1024))) digest from f",
    "frame_gauges": BYTES + " select stream_id, n // 2 available_samples, n // 1024 available_frames, n % 1024 rest_bytes, n / 8000.0e0 usage_ratio from b",
    "overflow_keep_tail": BYTES + ", k as (select stream_id, case when n > 8000 then array_slice(x, n - 3999, n) else x end kept from b) select stream_id, octet_length(kept) kept_bytes, octet_length(kept) // 1024 frames, md5(hex(kept)) digest from k",
    "hop_frames": f"with v as ({VEC}), h as (select vec_id, a, unnest(range((len(a) - 4) // 16)) i from v) select vec_id, i hop, len(list_slice(a, i * 16 + 1, i * 16 + 20)) samples, round(list_sum(list_slice(a, i * 16 + 1, i * 16 + 20)), 5) total from h",
    "pcm16_decode": BYTES + ", p as (select stream_id, hex(x) h from b), s as (select stream_id, list_transform(range(len(h) // 4), lambda k: ('0x' || substr(h, 4 * k + 3, 2) || substr(h, 4 * k + 1, 2))::int) a from p) select stream_id, len(a) samples, round(coalesce(list_sum(list_transform(a, lambda x: (case when x >= 32768 then x - 65536 else x end) / 32768.0e0)), 0.0e0), 6) total from s",
    "float_to_pcm16": "with v as (select vec_id, list_transform(embedding, lambda x: trunc(x::double * 32767.0e0)::bigint) a from embeddings) select vec_id, list_sum(a)::bigint total, list_max(a) highest, list_min(a) lowest from v",
    "alaw_decode": "with c as (select range code, (range >> 4) & 7 e, range & 15 m from range(256)) select code, (case when code & 128 <> 0 then -1 else 1 end) * (case when e = 0 then m << 4 else (m | 16) << (e + 3) end) / 32768.0e0 sample from c",
    "integer_decode": "with v as (select vec_id, list_transform(embedding, lambda x: trunc(x::double * 32767.0e0)::bigint) a from embeddings) select vec_id, round(list_sum(list_transform(a, lambda x: (x / 32768.0e0)::float::double)), 5) + 0.0e0 from_int16, round(list_sum(list_transform(a, lambda x: ((x * 65536)::float::double / 2147483648.0e0)::float::double)), 5) + 0.0e0 from_int32, round(list_sum(list_transform(a, lambda x: (floor(x / 256.0e0) / 127.0e0)::float::double)), 5) + 0.0e0 from_int8 from v",
    "resample_linear": f"with v as ({VEC}), n as (select vec_id, a, floor(len(a) * 16000.0e0 / 22050.0e0)::bigint n from v), p as (select vec_id, a, n, list_transform(range(n), lambda j: j * ((len(a) - 1) / greatest(n - 1, 1)::double)) pl from n), q as (select vec_id, a, pl, list_transform(pl, lambda t: least(floor(t)::bigint, len(a) - 1)) low from p) select vec_id, len(pl) samples, round(list_sum(list_transform(range(len(pl)), lambda j: (a[low[j + 1] + 1] + (a[least(low[j + 1] + 1, len(a) - 1) + 1] - a[low[j + 1] + 1]) * (pl[j + 1] - low[j + 1]))::float::double)), 5) total from q",
    "rms_level": f"with v as ({VEC}) select vec_id, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 6) level from v",
    "base64_segment": BYTES + " select stream_id, base64(x) encoded, from_base64(base64(x)) = x round_trip from b",
    "format_timestamp": ROLES + " select stream_id, segment_id, (first_frame * 32) // 1000 || '.' || lpad(((first_frame * 32) % 1000)::varchar, 3, '0') || 's' start_text, 'segment_' || lpad(segment_id::varchar, 3, '0') || '_' || first_frame * 32 || 'ms-' || last_frame * 32 || 'ms.wav' file_name from closed",
    "semver_parse": "with v as (select p_partkey, (p_partkey % 3)::int major, p_size::int minor, (p_partkey % 10)::int patch, p_partkey % 4 = 0 rc from part) select p_partkey, major, minor, patch, case when rc then 'rc.1' end pre, case when rc then 'b7' end build, major = 1 and (minor > 20 or (minor = 20 and patch >= 3)) compatible from v",
    "upsert_latest": "select conv_id, turn, role, length(text) n_chars from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1",
    "validate_chunks": "with r as (select event_id, ['wav', 'pcma', 'mp3'][event_id % 3 + 1] form, [8000, 16000, 22050, 11025][event_id % 4 + 1] rate, event_id % 3 channels, floor(value) chunk, event_id % 60 overlap from events) select event_id, form in ('wav', 'pcma') and rate <> 11025 and channels in (1, 2) and (form <> 'pcma' or (rate = 8000 and channels = 1)) format_ok, form in ('wav', 'pcma') and rate <> 11025 and channels = 1 and (form <> 'pcma' or rate in (8000, 16000)) config_ok, chunk > 0 and overlap < chunk chunk_ok, overlap < chunk * 10 * 0.5 and 100 <= chunk * 10 and 100 <= 2 * chunk * 10 and 30 <= chunk * 10 timing_ok from r",
    "frame_size_table": f"select sample_rate::int sample_rate, duration_ms::int duration_ms, samples::int samples, (duration_ms * sample_rate // 1000)::int formula_samples from (values {CHUNK_ROWS}) t(sample_rate, duration_ms, samples)",
    "chunk_times": "select event_id, round((floor(value)::bigint + 1) * 1000.0e0 / 16000, 6) duration_ms, round(event_id * 32.0e0 + (floor(value)::bigint + 1) * 1000.0e0 / 16000, 6) end_ms, floor(value)::bigint + 1 + 16 total_size, value / 100 >= 0.8e0 confident from events",
    "model_output": "select event_id, value / 500 >= 0.5e0 is_speech, round(case when value / 500 >= 0.5e0 then value / 500 else 1.0e0 - value / 500 end, 9) confidence from events",
    "longest_streams": "with " + roles_sql("frames as (select l_suppkey stream_id, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber) frame_id, case when l_quantity >= 40 then 'start' when l_quantity < 12 then 'end' end marker from lineitem)") + " select stream_id, count(*) segments, sum(frame_count)::bigint frames, max(last_frame - first_frame) * 32.0e0 longest_ms from closed group by 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "segments": segment_query, "stream_segments": streamed,
        **{f.__name__: f for f in (
            frame_results, results_union, byte_results, role_counts, dropped_frames, open_segments, hysteresis_markers, hysteresis_segments, processor_stats, latency_percentiles, last_n_ring, best_worst_key,
            spread_and_grade, isolation_check, concurrency_rollup, every_nth, health_flag, frame_align_bytes, frame_gauges, overflow_keep_tail, hop_frames, pcm16_decode, float_to_pcm16, alaw_decode,
            integer_decode, resample_linear, rms_level, base64_segment, format_timestamp, semver_parse, upsert_latest, validate_chunks, frame_size_table, chunk_times, model_output, longest_streams,
        )},
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
