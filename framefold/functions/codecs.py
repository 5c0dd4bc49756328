"""Sample encodings as Spark expressions; arrays in, arrays out. Binaries are decoded in Arrow batches by numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RATES, SAMPLE_RATE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def samples_of(data: pa.Array) -> Iterator[np.ndarray]:
    """The signed 16-bit little-endian samples of each binary, none of null; an odd last byte is left out."""
    data = data.cast(pa.large_binary())
    _, offsets, values = data.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(data) + 1, data.offset * 8) if len(data) else np.zeros(1, np.int64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield np.frombuffer(values, "<i2", (b - a) // 2, a) if b - a > 1 else np.zeros(0, "<i2")


def as_lists(parts: list[np.ndarray], like: pa.Array, kind: type) -> pa.Array:
    ends = np.cumsum([len(x) for x in parts]) if parts else np.zeros(0, np.int64)
    flat = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat), mask=like.is_null())


def pcm16_to_ints(data: Column) -> Column:
    """Signed 16-bit little-endian samples of a binary; an odd last byte is left out."""

    def decode(data: pa.Array) -> pa.Array:
        return as_lists(list(samples_of(data)), data, np.int32)

    return F.arrow_udf(decode, "array<int>")(data)


def pcm16_to_float(data: Column) -> Column:
    """Samples of a binary as floats within [-1, 1)."""

    def decode(data: pa.Array) -> pa.Array:
        return as_lists([x / np.float32(32768) for x in samples_of(data)], data, np.float32)

    return F.arrow_udf(decode, "array<float>")(data)


def pcm16_rms(data: Column) -> Column:
    """rms of the samples of a binary as floats: what rms(pcm16_to_float(data)) is, without an array for each row."""

    def level(data: pa.Array) -> pa.Array:
        squares = (np.square(x / 32768.0) for x in samples_of(data))
        return pa.array([float(np.sqrt(x.mean())) if len(x) else 0.0 for x in squares], pa.float64())

    return F.arrow_udf(level, "double")(data)


def int16_to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x / F.lit(32768.0)).cast("float"))


def int32_to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x.cast("float").cast("double") / F.lit(2147483648.0)).cast("float"))


def int8_to_float(samples: Column) -> Column:
    """Signed and unsigned bytes alike over 127; unsigned ones are not re-centred, so they reach 2.0079."""
    return F.transform(samples, lambda x: (x / F.lit(127.0)).cast("float"))


def to_float32(samples: Column) -> Column:
    return samples.cast("array<float>")


def float_to_int16(samples: Column) -> Column:
    """Times 32767, truncated toward zero; not the inverse of int16_to_float."""
    return F.transform(samples, lambda x: (x.cast("float") * F.lit(32767.0)).cast("int").cast("smallint"))


def ints_to_pcm16(samples: Column) -> Column:
    """Little-endian bytes of 16-bit samples."""
    digits = F.transform(samples, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(65536)).cast("long")), 4, "0"))
    return F.unhex(F.array_join(F.transform(digits, lambda d: F.concat(F.substring(d, 3, 2), F.substring(d, 1, 2))), ""))


def alaw_sample(code: Column) -> Column:
    """A byte (0-255) of this engine's A-law: no inversion of even bits and no half step, unlike G.711."""
    code = code.cast("int")
    exponent, mantissa = F.shiftright(code, 4).bitwiseAND(7), code.bitwiseAND(15)
    size = F.when(exponent == 0, F.shiftleft(mantissa, 4)).otherwise(F.call_function("shiftleft", mantissa.bitwiseOR(16), exponent + 3))
    return (F.when(code.bitwiseAND(128) != 0, -size).otherwise(size) / F.lit(32768.0)).cast("float")


def alaw_to_float(codes: Column) -> Column:
    return F.transform(codes, alaw_sample)


def alaw_codes(samples: Column) -> Column:
    """Codes carried in 16- or 32-bit integers: moved to 0-255 first."""
    return F.transform(samples, lambda x: F.floor((x.cast("long") + 32768) / 256).cast("int"))


def resample(samples: Column, source: int, target: int = SAMPLE_RATE) -> Column:
    """Linear interpolation over int(n * target / source) points from the first sample to the last; no filter."""
    if source == target:
        return to_float32(samples)

    def points(a: Column) -> Column:
        n = F.floor(F.size(a) * F.lit(float(target)) / F.lit(float(source)))
        step = (F.size(a) - 1) / F.greatest(n - 1, F.lit(1)).cast("double")

        def at(j: Column) -> Column:
            place = j * step
            low = F.least(F.floor(place), F.size(a).cast("long") - 1).cast("int")
            high = F.least(low + 1, F.size(a) - 1)
            x, y = a[low].cast("double"), a[high].cast("double")
            return (x + (y - x) * (place - low)).cast("float")

        return F.transform(indices(n), at)

    return let(samples, points)


def to_internal(samples: Column, kind: Column, form: Column, rate: int) -> Column:
    """Samples of any accepted element kind and format as floats at SAMPLE_RATE; samples are doubles, kind names what they were."""
    values = (
        F.when(form == "pcma", F.when(kind.isin("int16", "int32"), alaw_to_float(alaw_codes(samples))).otherwise(alaw_to_float(samples)))
        .when(kind == "int16", int16_to_float(samples)).when(kind == "int32", int32_to_float(samples)).when(kind.isin("float32", "float64"), to_float32(samples)).when(kind.isin("int8", "uint8"), int8_to_float(samples))
    )
    refused = F.coalesce(F.size(samples) < 1, F.lit(True)) | ~kind.isin("int8", "uint8", "int16", "int32", "float32", "float64") | ~form.isin("wav", "pcma") | (form.eqNullSafe(F.lit("pcma")) & kind.isin("float32", "float64")) | ~F.lit(rate in RATES)
    return F.when(~F.coalesce(refused, F.lit(True)), resample(values, rate))


def rms(samples: Column) -> Column:
    """Root of the mean square; 0.0 of no samples."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(square / F.size(samples))).otherwise(0.0)
