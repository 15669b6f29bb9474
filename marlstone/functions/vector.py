"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns, JVM-side."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where lengths differ, a side is empty, or a norm is 0; null where a side is null."""
    size = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    # Both norms and the product in one pass over the zipped arrays.
    acc = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    zipped = F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    sums = lambda s, p: F.struct((s.d + p.x * p.y).alias("d"), (s.a + p.x * p.x).alias("a"), (s.b + p.y * p.y).alias("b"))
    ratio = F.aggregate(zipped, acc, sums, lambda s: F.when((s.a > 0) & (s.b > 0), s.d / (F.sqrt(s.a) * F.sqrt(s.b))).otherwise(0.0))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(size, ratio).otherwise(0.0)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine with a constant vector, whose norm is taken once."""
    length = sum(x * x for x in query) ** 0.5
    if not query or not length:
        return F.when(a.isNotNull(), F.lit(0.0))
    q = F.lit([float(x) for x in query])
    acc = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("a"))
    zipped = F.zip_with(_doubles(a), q, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    ratio = F.aggregate(zipped, acc, lambda s, p: F.struct((s.d + p.x * p.y).alias("d"), (s.a + p.x * p.x).alias("a")), lambda s: F.when(s.a > 0, s.d / (F.sqrt(s.a) * F.lit(length))).otherwise(0.0))
    return F.when(a.isNull(), F.lit(None).cast("double")).when(F.size(a) == len(query), ratio).otherwise(0.0)


def distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def byte_embedding(text: Column, dims: int = 768, pad: float = 0.0) -> Column:
    """The first ``dims`` UTF-8 bytes over 255, then ``pad``."""
    hexed = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    one = lambda i: F.when(2 * i < F.length(hexed), F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255).otherwise(F.lit(pad))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), one)


def json_vector(text: Column) -> Column:
    """A JSON list of numbers as doubles; null if it is anything else."""
    strings = F.from_json(text, "array<string>")
    numbers = F.transform(strings, lambda x: x.try_cast("double"))
    return F.when(F.size(strings) > 0, F.when(~F.exists(numbers, lambda x: x.isNull()), numbers))


def pack_floats(v: Column) -> Column:
    """Little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def packed(series: pd.Series) -> pd.Series:
        return series.map(lambda x: None if x is None else struct.pack(f"<{len(x)}f", *x))

    return packed(v)


def unpack_floats(v: Column) -> Column:
    """From little-endian 32-bit floats; null if the length is no multiple of four."""

    @F.pandas_udf("array<float>")
    def unpacked(series: pd.Series) -> pd.Series:
        return series.map(lambda x: None if x is None or len(x) % 4 else list(struct.unpack(f"<{len(x) // 4}f", x)))

    return unpacked(v)
