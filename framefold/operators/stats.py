"""Running statistics, latency figures and their grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

MEMORY_MB = 80.0
#: Rows of a key that one task takes for a ring.
RING_BLOCK = 16384


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0.0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def processor_stats(results: DataFrame, chunks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """schemas.STATS from results (result_type) and chunks (processing_time_ms, error boolean).

    speech_ratio counts results, not time. error_rate divides by the chunks that went well, so it may exceed 1, and is 0.0 if none did.
    """
    keys = list(keys)
    made = results.groupBy(*keys).agg(F.count_if(F.col("result_type") == "segment").alias("speech_segments"), F.count_if(F.col("result_type") == "frame").alias("single_frames"))
    fine = ~F.coalesce("error", F.lit(False))
    done = chunks.groupBy(*keys).agg(F.count_if(fine).alias("ok"), F.coalesce(F.sum(F.when(fine, F.col("processing_time_ms"))), F.lit(0.0)).alias("total"), F.count_if(~fine).alias("error_count"))
    both = done.join(made, keys, "left") if keys else done.crossJoin(made)
    seg, one = (F.coalesce(c, F.lit(0)) for c in ("speech_segments", "single_frames"))
    return both.select(
        *keys, F.col("ok").alias("total_chunks_processed"), F.col("total").alias("total_processing_time_ms"), ratio(F.col("total"), F.col("ok")).alias("average_processing_time_ms"),
        seg.alias("speech_segments"), one.alias("single_frames"), ratio(seg, seg + one).alias("speech_ratio"), ratio(F.col("ok"), F.col("total") / 1000).alias("throughput_chunks_per_second"),
        F.lit(MEMORY_MB).alias("memory_usage_mb"), "error_count", ratio(F.col("error_count"), F.col("ok")).alias("error_rate"),
    )


def latency(rows: DataFrame, value: str, keys: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Mean, percentiles, bounds and rate; percentiles are of a mergeable sketch unless exact, which holds all distinct values of a key in one task."""
    wanted = [0.5, 0.95, 0.99]
    cuts = F.percentile(value, F.array(*map(F.lit, wanted))) if exact else F.percentile_approx(value, wanted, 10000)
    found = rows.groupBy(*keys).agg(F.avg(value).alias("avg_latency_ms"), cuts.alias("p"), F.max(value).alias("max_latency_ms"), F.min(value).alias("min_latency_ms"), ratio(F.lit(1000.0), F.avg(value)).alias("fps"), F.count(value).alias("success_count"))
    return found.select(*keys, "avg_latency_ms", *[F.col("p")[k].alias(f"p{n}_latency_ms") for k, n in enumerate((50, 95, 99))], "max_latency_ms", "min_latency_ms", "fps", "success_count")


def last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 100, part: Column | None = None) -> DataFrame:
    """rows with the mean, maximum and size of the last n values at each row.

    With part (as in numbering.numbered) no task holds a whole key: the ring runs over blocks of
    rows, to each of which the last n - 1 rows of the block before are copied.
    """
    if part is None:
        return with_ring(rows, keys, order, value, n)
    rows = numbered(rows, keys, order, part, "__n").withColumn("__n", F.col("__n") - 1)
    size = max(RING_BLOCK, n)
    own = F.expr(f"__n div {size}")
    copied = F.when(F.col("__n") % size > size - n, F.array(own, own + 1)).otherwise(F.array(own))
    blocks = with_ring(rows.withColumn("__block", F.explode(copied)), [*keys, "__block"], ["__n"], value, n)
    return blocks.filter(F.col("__block") == own).drop("__n", "__block")


def with_ring(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    ring = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.withColumns({"ring_mean": F.avg(value).over(ring), "ring_max": F.max(value).over(ring), "ring_size": F.count(value).over(ring)})


def success(ok: Column, errors: Column) -> dict[str, Column]:
    return {"total_operations": ok + errors, "success_rate": ratio(ok, ok + errors)}


def healthy(error_rate: Column, qps: Column, p99_ms: Column, most_errors: float = 0.01, least_qps: float = 1.0, most_ms: float = 100.0) -> Column:
    return (error_rate <= most_errors) & (qps >= least_qps) & (p99_ms <= most_ms)


def operational(status: Column) -> Column:
    return status.isin("healthy", "warning")


def grade(fps: Column, latency_ms: Column) -> Column:
    """excellent, good, fair or poor."""
    return F.when((fps > 100) & (latency_ms < 50), "excellent").when((fps > 50) & (latency_ms < 100), "good").when((fps > 20) & (latency_ms < 200), "fair").otherwise("poor")


def extremes(rows: DataFrame, name: str, cost: str, gain: str) -> DataFrame:
    """The name with the least cost and the one with the largest gain; ties to the least name."""
    return rows.agg(F.min(F.struct(cost, name))[name].alias("least_cost"), F.min(F.struct((-F.col(gain)).alias("g"), name))[name].alias("largest_gain"))


def spread(value: str, most: float = 1000.0) -> dict[str, Column]:
    """max - min and whether that is below most."""
    wide = F.max(value) - F.min(value)
    return {"spread": wide, "is_even": wide < most}


def all_distinct(name: str) -> Column:
    return F.count_distinct(name) == F.count(name)


def rollup(rows: DataFrame, keys: Sequence[str], frames: str) -> DataFrame:
    """Sums over concurrent streams: frames, streams with any, their share and the mean."""
    return rows.groupBy(*keys).agg(F.sum(frames).alias("total_frames"), F.count_if(F.col(frames) > 0).alias("active_streams"), (F.count_if(F.col(frames) > 0) / F.count("*")).alias("success_rate"), F.avg(frames).alias("mean_frames"))
