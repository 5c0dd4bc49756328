"""Row numbers within keys that may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], part: Column | None = None, name: str = "number") -> DataFrame:
    """rows with name: a row's number from 1 among those of its key, in order, which must be total within the key.

    Without part, one task sorts a whole key. part never falls as order rises (the hour of a time, a
    run of ids): then a task sorts one part of a key, and the parts before it are only counted.
    Null keys are a key of their own, and null parts come first, as null order does.
    """
    keys = list(keys)
    if part is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    rows = rows.withColumn("__part", part)
    sizes = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    by = [*keys, "__part"]
    ahead = sizes.select(*[F.col(c).alias(f"__ahead_{c}") for c in by], F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    met = rows.withColumn(name, within.cast("long")).join(ahead, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__ahead_{c}")) for c in by]))
    return met.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before", *[f"__ahead_{c}" for c in by])
