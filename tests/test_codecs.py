import numpy as np
import pytest
from pyspark.sql import functions as F

from framefold.functions import codecs, text


def values(spark, column, rows=None, schema=None):
    df = spark.createDataFrame(rows, schema) if rows else spark.range(1)
    return [r[0] for r in df.select(column).collect()]


def test_pcm16_round(spark):
    raw = np.array([0, 1, -1, 32767, -32768, 1234], "<i2")
    got = values(spark, codecs.pcm16_to_float(F.col("d")), [(bytearray(raw.tobytes() + b"x"),)], "d binary")[0]
    assert got == (raw.astype(np.float32) / 32768).tolist()
    assert bytes(values(spark, codecs.ints_to_pcm16(codecs.pcm16_to_ints(F.col("d"))), [(bytearray(raw.tobytes()),)], "d binary")[0]) == raw.tobytes()
    assert values(spark, codecs.pcm16_to_float(F.col("d")), [(bytearray(b""),)], "d binary")[0] == []


def test_float_to_int16_truncates(spark):
    got = values(spark, codecs.float_to_int16(F.col("a")), [([1.0, -1.0, 0.5, 1e-5, -3.3e-5],)], "a array<float>")[0]
    assert got == [32767, -32767, 16383, 0, -1]


def test_alaw_table(spark):
    got = [r[0] for r in spark.range(256).orderBy("id").select(codecs.alaw_sample(F.col("id"))).collect()]
    assert got[0] == 0 and got[127] == 0.96875 and got[255] == -0.96875 and len(set(got)) == 255
    assert got[16] == (16 << 3 >> 0) * 2 / 32768 or got[16] == 256 / 32768


@pytest.mark.parametrize("rate", [8000, 22050, 44100, 48000])
@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_resample(spark, rate, n):
    a = np.sin(np.arange(n)).astype(np.float32)
    got = values(spark, codecs.resample(F.col("a"), rate), [(a.tolist(),)], "a array<float>")[0]
    m = int(n * 16000 / rate)
    want = np.interp(np.linspace(0, n - 1, m), np.arange(n), a).astype(np.float32) if m and n else np.zeros(0)
    assert np.allclose(got, want, atol=1e-7) and len(got) == m


def test_dispatch(spark):
    rows = [([127.0], "int8", "wav"), ([255.0], "uint8", "wav"), ([16384.0], "int16", "wav"), ([1073741824.0], "int32", "wav"), ([0.25], "float64", "wav"), ([127.0], "uint8", "pcma"), ([0.5], "float32", "pcma"), ([], "int16", "wav"), ([1.0], "text", "wav")]
    df = spark.createDataFrame(rows, "a array<double>, k string, f string")
    got = [r[0] for r in df.select(codecs.to_internal(F.col("a"), F.col("k"), F.col("f"), 16000)).collect()]
    assert got[:2] == [[1.0], [np.float32(255 / 127)]] and got[2:6] == [[0.5], [0.5], [0.25], [0.96875]] and got[6:] == [None] * 3


def test_text(spark):
    row = spark.range(1).select(
        text.seconds(F.lit(61032.0)).alias("t"), text.base64_line(F.lit(b"x" * 90)).alias("b"), text.version_part(F.lit("1.2.3-a+b"), "pre").alias("pre"), text.version_part(F.lit("1.2"), "major").alias("bad"),
        text.version_compatible(F.lit("1.2.3"), F.lit("1.2.2")).alias("ok"), text.segment_file("s", F.lit(7), F.lit(32.9), F.lit(64.0)).alias("f"), codecs.rms(F.array(F.lit(3.0), F.lit(4.0))).alias("r"),
        text.merged_maps(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3)")).alias("m"),
    ).first()
    assert row.t == "61.032s" and len(row.b) == 120 and row.pre == "a" and row.bad is None and row.ok and row.f == "s_007_32ms-64ms.wav" and row.r == pytest.approx(12.5**0.5) and row.m == {"a": 1, "b": 3}
