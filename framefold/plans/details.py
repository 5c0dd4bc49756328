"""Queries over the sources, sinks, checks and renderings, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import codecs, text
from ..operators import framing, scoring, segments, stats, validate
from ..sources import files, streams
from . import catalogue
from .catalogue import BYTES, KEY, ROLES, VEC, digest, document_bytes, event_chunks, event_frames, table, vectors


def total(samples: Column) -> Column:
    return F.round(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double")), 5) + 0.0


def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as WAV files and parsed again."""
    rows = document_bytes(spark, sf_dir).select(F.col("stream_id").cast("string").alias("path"), sinks.wav(F.col("data")).alias("content"))
    found = files.parsed_wav(rows)
    return found.select(F.col("path").cast("long").alias("stream_id"), "format", "channels", "sample_rate", "bits", F.length("payload").cast("long").alias("n_bytes"), digest(F.col("payload")).alias("digest"), "error")


def chunk_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents played as chunks of 4096 bytes, the last one short."""
    rows = files.chunked(document_bytes(spark, sf_dir), 4096, "data", "stream_id")
    return rows.select("stream_id", "seq", F.length("data").cast("long").alias("n_bytes"), digest(F.col("data")).alias("digest"))


def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float samples as frames of 16-bit audio, 16 samples each."""
    rows = files.sample_frames(vectors(spark, sf_dir).select(F.col("vec_id").alias("stream_id"), F.col("embedding").alias("samples")), 16)
    return rows.select("stream_id", "frame_id", "timestamp_ms", F.hex("audio_data").alias("audio"))


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as control and audio messages; every fifth client is new."""
    rows = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "error", F.lit('{"type":"stop"}')).when(F.col("event_id") % 10 == 0, F.format_string('{"type":"start","config":{"vad_threshold":0.%d}}', F.col("event_id") % 9 + 1))
    client = F.when(F.col("user_id") % 5 == 0, "new").otherwise(F.col("user_id").cast("string"))
    rows = rows.select(client.alias("client_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("connection"), F.col("event_id").alias("seq"), said.alias("text"), F.lit(b"\x00\x01").alias("data"))
    return streams.from_messages(rows).select("stream_id", "seq", "kind", F.col("config")["vad_threshold"].alias("vad_threshold"))


def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What byte_results has, by the keyed state of the streaming operator."""
    from ..api import Engine

    with Engine(spark) as engine:
        found = engine.from_stream(event_chunks(spark, sf_dir).withColumn("stream_id", F.col("stream_id").cast("string")))
    return found.select(
        F.col("stream_id").cast("long").alias("stream_id"), "result_type", "frame_id", "segment_id", F.col("start_timestamp_ms").alias("start_ms"), F.col("end_timestamp_ms").alias("end_ms"), F.col("frame_count").alias("frames"),
        digest(F.col("audio_data")).alias("digest"),
    )


def segment_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON messages of segments, with audio in base64."""
    rows = catalogue.closed(spark, sf_dir)
    part = F.struct("segment_id", "start_timestamp_ms", "end_timestamp_ms", F.encode(F.concat_ws("-", "stream_id", "segment_id"), "UTF-8").alias("audio_data"))
    return rows.select("stream_id", "segment_id", part.alias("segment")).select("stream_id", "segment_id", sinks.message().alias("message"))


def segments_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.only(catalogue.results_union(spark, sf_dir), "segment").select("stream_id", "segment_id", "duration_ms", "instance_id")


def segment_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and bytes that a segment collects, its audio met after the windows."""
    frames = event_frames(spark, sf_dir).withColumn("audio_data", F.encode(F.format_string("%d;", "frame_id"), "UTF-8"))
    rows = catalogue.roles(spark, sf_dir)
    found = segments.segments_audio(segments.segments(rows, KEY), frames.select("stream_id", "frame_id", "audio_data"), rows, KEY)
    return found.select("stream_id", "segment_id", "frame_count", F.length("audio_data").cast("long").alias("n_bytes"), F.decode("audio_data", "UTF-8").alias("audio"))


def sample_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of any element kind, in both formats, as floats; null where they are refused."""
    form = F.when(F.col("vec_id") % 3 == 0, "pcma").otherwise("wav")
    kind = F.element_at(F.array(*map(F.lit, ("int16", "int32", "float32", "uint8", "text"))), (F.col("vec_id") % 5 + 1).cast("int"))
    whole = F.transform("embedding", lambda x: F.pmod((x.cast("double") * 100).cast("int"), F.lit(256)).cast("double"))
    rows = vectors(spark, sf_dir).select("vec_id", form.alias("form"), kind.alias("kind"), whole.alias("whole"))
    rows = rows.withColumn("a", codecs.to_internal(F.col("whole"), F.col("kind"), F.col("form"), 16000))
    return rows.select("vec_id", "form", "kind", F.size(F.coalesce("a", F.expr("cast(array() as array<float>)"))).cast("long").alias("samples"), total(F.col("a")).alias("total"))


def alaw_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", codecs.alaw_to_float(codecs.alaw_codes(codecs.float_to_int16(F.col("embedding")))).alias("a"))
    return rows.select("vec_id", F.size("a").cast("long").alias("samples"), total(F.col("a")).alias("total"))


def narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles narrowed to floats."""
    rows = vectors(spark, sf_dir).select("vec_id", codecs.to_float32(F.transform("embedding", lambda x: x.cast("double") / 3)).alias("a"))
    return rows.select("vec_id", total(F.col("a")).alias("total"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer whose state runs through each stream, called by its name."""
    rows = scoring.model_score(event_frames(spark, sf_dir).select("stream_id", "frame_id", F.col("score").alias("level")), scoring.scorer("column", None, "level"))
    return rows.select("stream_id", "frame_id", F.round(F.sum("score").over(catalogue.Window.partitionBy("stream_id").orderBy("frame_id").rowsBetween(-3, 0)), 6).alias("recent"), F.round("score", 6).alias("score"))


def marker_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    kind = scoring.marker_kind(F.when(F.col("value") >= 60, F.col("value")), F.when(F.col("value") < 35, F.col("value")))
    given = F.when(F.col("event_id") % 2 == 0, F.col("value") / 100)
    rows = rows.select("event_id", kind.alias("kind"), F.round(scoring.marker_probability(kind, given), 9).alias("probability"))
    return rows.withColumn("share", validate.speech_share(F.col("kind").isNotNull(), F.col("probability")))


def renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.closed(spark, sf_dir)
    frame = text.frame_text(F.col("first_frame"), F.col("start_timestamp_ms"), F.when(F.col("segment_id") % 2 == 0, "start"))
    return rows.select("stream_id", "segment_id", frame.alias("frame_text"), text.segment_text(F.col("segment_id"), F.col("start_timestamp_ms"), F.col("end_timestamp_ms"), F.col("frame_count")).alias("segment_text"), text.stats_text(F.col("frame_count"), F.col("segment_id"), F.col("duration_ms")).alias("stats_text"))


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error struct of rows that a check refuses."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    found = validate.checked(rows, F.col("value") < 100, "INVALID_INPUT", "too loud")
    return found.select("event_id", F.col("error")["error_code"].alias("error_code"), F.col("error")["message"].alias("message"), F.col("error")["severity"].alias("severity"))


def buffer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.floor("value").cast("int").alias("n"))
    level = F.when(F.col("n") > 90, "critical").when(F.col("n") > 70, "warning").otherwise("healthy")
    none = F.col("event_id") % 3
    return rows.select(
        "event_id", validate.interval_ok(F.lit(50), F.col("n")).alias("interval_ok"), validate.capacity_ok(F.col("n") * 4, F.col("event_id") % 2 + 1).alias("capacity_ok"), validate.buffer_ok(F.col("n"), F.lit(80)).alias("buffer_ok"),
        validate.buffer_healthy(level, none).alias("healthy"), stats.operational(level).alias("operational"),
    )


def option_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of options as one; the right one wins."""
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.col("event_type")).alias("x"), F.create_map(F.when(F.col("event_id") % 2 == 0, "a").otherwise("c"), F.lit("right")).alias("y"))
    both = F.transform(F.array_sort(F.map_entries(text.merged_maps(F.col("x"), F.col("y")))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("event_id", F.array_join(both, ";").alias("options"))


def required_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("event_id") % 2 == 0, 16000).otherwise(8000)
    ms = F.floor("value").cast("int")
    return table(spark, sf_dir, "events").select("event_id", framing.model_samples(rate).alias("model_samples"), framing.frame_samples(ms, rate).alias("frame_samples"))


def first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten results of each stream, as a caller who stops after ten sees them."""
    rows = catalogue.closed(spark, sf_dir)
    return rows.filter(F.col("segment_id") <= 10).select("stream_id", "segment_id", "end_timestamp_ms")


def latency_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and mean latency and the rate that the mean gives, of sketched rows."""
    found = stats.latency(table(spark, sf_dir, "events"), "value", ["user_id"])
    return found.select("user_id", "success_count", *[F.round(c, 6).alias(c) for c in ("min_latency_ms", "avg_latency_ms", "fps")])


def silent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of zero bytes, framed."""
    rows = framing.aligned(files.silence(spark, 40, 700)).withColumn("level", codecs.pcm16_rms(F.col("audio_data")))
    return rows.select("stream_id", "frame_id", F.length("audio_data").cast("long").alias("n_bytes"), "level")


LE_FRAMES = f"""with v as ({VEC}), i as (select vec_id, list_transform(a, lambda x: trunc(x * 32767.0e0)::bigint) a from v), h as (select vec_id, list_transform(a, lambda x: printf('%04X', (case when x < 0 then x + 65536 else x end)::bigint)) a from i),
 s as (select vec_id, list_transform(a, lambda x: substr(x, 3, 2) || substr(x, 1, 2)) a from h), f as (select vec_id, a, unnest(range(len(a) // 16)) k from s)"""
ALAW = "(case when {c} & 128 <> 0 then -1 else 1 end) * (case when ({c} >> 4) & 7 = 0 then ({c} & 15) << 4 else (({c} & 15) | 16) << ((({c} >> 4) & 7) + 3) end) / 32768.0e0"
SUM = "round(list_sum(list_transform({a}, lambda x: ({of})::float::double)), 5) + 0.0e0"


def alaw_sql(code: str) -> str:
    return ALAW.replace("{c}", f"({code})")


def sum_sql(of: str, a: str = "a") -> str:
    return SUM.replace("{of}", of).replace("{a}", a)


ORACLE = {
    "wav_round_trip": BYTES + " select stream_id, 1::int format, 1::int channels, 16000::int sample_rate, 16::int bits, n n_bytes, md5(hex(x)) digest, null::varchar error from b",
    "chunk_playback": BYTES + ", c as (select stream_id, x, n, unnest(range((n + 4095) // 4096)) seq from b) select stream_id, seq, least(4096, n - seq * 4096) n_bytes, md5(hex(array_slice(x, seq * 4096 + 1, least(n, seq * 4096 + 4096)))) digest from c",
    "sample_frames": LE_FRAMES + " select vec_id stream_id, k + 1 frame_id, (k + 1) * 32.0e0 timestamp_ms, array_to_string(list_slice(a, k * 16 + 1, k * 16 + 16), '') audio from f",
    "session_messages": """select case when user_id % 5 = 0 then 'new-' || substr(sha256('c' || user_id), 1, 16) else user_id::varchar end stream_id, event_id seq, case when event_type = 'error' then 'stop' when event_id % 10 = 0 then 'start' else 'data' end kind,
 case when event_type <> 'error' and event_id % 10 = 0 then ('0.' || (event_id % 9 + 1))::double end vad_threshold from events""",
    "stream_results": catalogue.ORACLE["byte_results"],
    "segment_messages": ROLES + """ select stream_id, segment_id, '{"type":"segment","segment_id":' || segment_id || ',"start_ms":' || (first_frame * 32.0e0)::varchar || ',"end_ms":' || (last_frame * 32.0e0)::varchar || ',"duration_ms":' || ((last_frame - first_frame) * 32.0e0)::varchar
 || ',"audio":"' || base64(encode(stream_id || '-' || segment_id)) || '"}' message from closed""",
    "segments_only": ROLES + " select stream_id, segment_id, (last_frame - first_frame) * 32.0e0 duration_ms, 'stream_processor' instance_id from closed",
    "segment_bytes": ROLES + """, own as (select r.stream_id, r.segment_id, r.frame_id from roles r join closed c on r.stream_id = c.stream_id and r.segment_id = c.segment_id where role in ('open', 'mid', 'close'))
 select stream_id, segment_id, count(*) frame_count, octet_length(encode(string_agg(frame_id || ';', '' order by frame_id))) n_bytes, string_agg(frame_id || ';', '' order by frame_id) audio from own group by 1, 2""",
    "sample_kinds": f"""with v as ({VEC}), w as (select vec_id, case when vec_id % 3 = 0 then 'pcma' else 'wav' end form, ['int16', 'int32', 'float32', 'uint8', 'text'][vec_id % 5 + 1] kind, list_transform(a, lambda x: (trunc(x * 100)::bigint % 256 + 256) % 256) a from v),
 s as (select *, case when form = 'pcma' and kind in ('int16', 'int32') then {sum_sql(alaw_sql('(x::bigint + 32768) // 256'))} when form = 'pcma' and kind = 'uint8' then {sum_sql(alaw_sql('x::bigint'))} when form = 'pcma' then null
 when kind = 'int16' then {sum_sql('x / 32768.0e0')} when kind = 'int32' then {sum_sql('x / 2147483648.0e0')} when kind = 'float32' then {sum_sql('x')} when kind = 'uint8' then {sum_sql('x / 127.0e0')} end total from w)
 select vec_id, form, kind, case when total is null then 0 else len(a) end::bigint samples, total from s""",
    "alaw_arrays": f"with v as ({VEC}), i as (select vec_id, list_transform(a, lambda x: (trunc(x * 32767.0e0)::bigint + 32768) // 256) a from v) select vec_id, len(a) samples, {sum_sql(alaw_sql('x'))} total from i",
    "narrowed": f"with v as ({VEC}) select vec_id, {sum_sql('x / 3')} total from v",
    "model_scores": ROLES + " select stream_id, frame_id, round(sum(score) over (partition by stream_id order by frame_id rows between 3 preceding and current row), 6) recent, round(score, 6) score from frames",
    "marker_probabilities": """with k as (select event_id, value, case when value >= 60 then 'start' when value < 35 then 'end' end kind from events), p as (select event_id, kind, round(case when kind is not null then 1.0e0 when event_id % 2 = 0 then value / 100 else 0.0e0 end, 9) probability from k)
 select event_id, kind, probability, case when kind is not null then probability else 0.0e0 end share from p""",
    "renderings": ROLES + """ select stream_id, segment_id, 'frame ' || first_frame || ' at ' || (first_frame * 32) || '.0 ms (' || case when segment_id % 2 = 0 then 'start' else 'none' end || ')' frame_text,
 'segment ' || segment_id || ' from ' || (first_frame * 32) || '.0 ms to ' || (last_frame * 32) || '.0 ms, ' || frame_count || ' frames' segment_text, frame_count || ' chunks, ' || segment_id || ' segments, ' || ((last_frame - first_frame) * 32) || '.0 ms each' stats_text from closed""",
    "error_rows": "select event_id, case when value >= 100 then 'E0001' end error_code, case when value >= 100 then 'too loud' end message, case when value >= 100 then 'medium' end severity from events",
    "buffer_checks": """with r as (select event_id, floor(value)::int n, case when floor(value) > 90 then 'critical' when floor(value) > 70 then 'warning' else 'healthy' end level from events)
 select event_id, n > 50 interval_ok, n > 0 and n * 4 <= 300 and event_id % 2 = 0 capacity_ok, n between 0 and 80 buffer_ok, level <> 'critical' and event_id % 3 = 0 healthy, level <> 'critical' operational from r""",
    "option_maps": "select event_id, case when event_id % 2 = 0 then 'a=right;b=' || event_type else 'a=left;b=' || event_type || ';c=right' end options from events",
    "required_samples": "select event_id, (case when event_id % 2 = 0 then 512 else 256 end)::int model_samples, (floor(value)::bigint * case when event_id % 2 = 0 then 16000 else 8000 end // 1000)::int frame_samples from events",
    "first_results": ROLES + " select stream_id, segment_id, last_frame * 32.0e0 end_timestamp_ms from closed where segment_id <= 10",
    "latency_bounds": "select user_id, count(value) success_count, round(min(value), 6) min_latency_ms, round(avg(value), 6) avg_latency_ms, round(1000.0e0 / avg(value), 6) fps from events group by 1",
    "silent_chunks": "select 'silence' stream_id, range + 1 frame_id, 1024::bigint n_bytes, 0.0e0 as level from range(27)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        wav_round_trip, chunk_playback, sample_frames, session_messages, stream_results, segment_messages, segments_only, segment_bytes, sample_kinds, alaw_arrays, narrowed, model_scores, marker_probabilities, renderings, error_rows,
        buffer_checks, option_maps, required_samples, first_results, latency_bounds, silent_chunks,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
