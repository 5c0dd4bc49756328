"""Numbers and rings of long keys, block by block, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from framefold.operators import numbering, segments, stats

SCHEMA = "k string, at long, v double, number_of_part string"


def made(spark, n=700):
    dice = random.Random(5)
    rows = [(dice.choice(["a", "a", "a", "b", None]), at, dice.choice([None, dice.random(), 1.0]), "extra") for at in range(n)]
    dice.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


def of_keys(rows):
    for key in ("a", "b", None):
        yield key, sorted((r for r in rows if r[0] == key), key=lambda r: r[1])


@pytest.mark.parametrize("part", [None, "at div 50", "if(at < 100, null, at div 300)"])
def test_numbers_and_every_nth(spark, part):
    rows, df = made(spark)
    cut = F.expr(part) if part else None
    got = {(r.k, r["at"]): r.number for r in numbering.numbered(df, ["k"], ["at"], cut).collect()}
    want = {(key, r[1]): i + 1 for key, own in of_keys(rows) for i, r in enumerate(own)}
    assert got == want
    seventh = segments.every_nth(df, 7, ["k"], "at", cut)
    assert seventh.columns == df.columns and {(r.k, r["at"]) for r in seventh.collect()} == {k for k, i in want.items() if i % 7 == 0}


@pytest.mark.parametrize("block, n", [(16384, 100), (40, 40), (33, 9), (5, 60), (1, 1)])
def test_ring_of_a_long_key(spark, monkeypatch, block, n):
    rows, df = made(spark)
    monkeypatch.setattr(stats, "RING_BLOCK", block)
    got = {(r.k, r["at"]): (r.ring_mean, r.ring_max, r.ring_size) for r in stats.last_n(df, ["k"], ["at"], "v", n, F.expr("at div 50")).collect()}
    assert len(got) == len(rows)
    for key, own in of_keys(rows):
        for i, r in enumerate(own):
            last = [x[2] for x in own[max(0, i + 1 - n) : i + 1] if x[2] is not None]
            mean, most, size = got[key, r[1]]
            assert size == len(last) and most == max(last, default=None) and (mean == pytest.approx(sum(last) / len(last)) if last else mean is None)


def test_no_rows(spark):
    none = made(spark, 1)[1].limit(0)
    assert numbering.numbered(none, ["k"], ["at"], F.col("at")).count() == 0 == stats.last_n(none, ["k"], ["at"], "v", 3, F.col("at")).count()
