import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import overlap
from spanlake.operators.overlap import overlap_join

LEFT = "k string, a int, b int, l int"
RIGHT = "k string, c int, d int, r int"


def brute(left, right, closed=False):
    e = 1 if closed else 0
    return sorted((k, a, b, i, c, d, j) for k, a, b, i in left for h, c, d, j in right
                  if None not in (k, a, b, c, d) and k == h and a < b + e and c < d + e and a < d + e and c < b + e)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def intervals(rng, n, keys, span, longest):
    out = []
    for i in range(n):
        s = rng.randint(-span, span)
        out.append((rng.choice(keys), s, s + rng.choice((0, 1, 2, 3, longest)) - rng.choice((0, 0, 1)), i))
    return out


@pytest.mark.parametrize("cell, cell_rows, closed", [(None, 20000, False), (None, 10, False), (None, 1, True), (1, 9, False), (7, 9, True), (1000, 9, False)])
def test_against_all_pairs(spark, cell, cell_rows, closed):
    rng = random.Random(repr((cell, cell_rows, closed)))
    hot = ["hot"] * 6 + ["b", "c", None]
    left, right = intervals(rng, 150, hot, 40, 30), intervals(rng, 200, hot, 40, 60)
    left += [("b", None, 4, 900), ("b", 4, None, 901), left[0], left[0]]
    got = overlap_join(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT), ["k"], ("a", "b"), ("c", "d"), cell, closed, cell_rows)
    assert got.columns == ["k", "a", "b", "l", "c", "d", "r"]
    want = brute(left, right, closed)
    assert rows_of(got) == want and len(want) > 500


def test_a_hot_record_is_cut(spark):
    """One record holds all rows; no task sees more than a few cells, and intervals over all cells still meet everything once."""
    n = 30_000
    left = spark.range(n).selectExpr("1 as k", "id * 10 as a", "id * 10 + 15 as b", "id as l")
    right = spark.range(n).selectExpr("1 as k", "id * 10 + 5 as c", "id * 10 + 6 as d", "id as r").unionByName(spark.createDataFrame([(1, 0, n * 10, -1)], "k int, c long, d long, r long"))
    got = overlap_join(left, right, ["k"], ("a", "b"), ("c", "d"), cell_rows=500)
    # [a, a + 15) meets the points a + 5 only, and the interval over everything; a + 15 is the start of the next point.
    assert got.filter("r >= 0").count() == n and got.filter("r < 0").count() == n
    assert got.filter("r >= 0 and l <> r").count() == 0


def test_many_batches_and_pairs(spark, monkeypatch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    monkeypatch.setattr(overlap, "PAIRS", 20)
    try:
        rng = random.Random(3)
        left, right = intervals(rng, 120, ["x", "y"], 50, 90), intervals(rng, 120, ["x", "y"], 50, 5)
        got = overlap_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], ("a", "b"), ("c", "d"), cell_rows=15)
        assert rows_of(got) == brute(left, right)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_dates_timestamps_keys_and_payload(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    left = spark.createDataFrame([(1, "x", day(0), day(3), [1, 2]), (1, "x", day(5), day(6), None)], "k int, j string, a date, b date, l array<int>")
    right = spark.createDataFrame([(1, "x", day(2), day(9), {"p": 1})], "k int, j string, c date, d date, r map<string,int>")
    got = overlap_join(left, right, ["k", "j"], ("a", "b"), ("c", "d")).orderBy("a").collect()
    assert [(r["k"], r["j"], r["l"], r["r"]) for r in got] == [(1, "x", [1, 2], {"p": 1}), (1, "x", None, {"p": 1})]
    stamps = [df.select("k", *[F.col(c).cast("timestamp").alias(c) for c in cs]) for df, cs in ((left, "ab"), (right, "cd"))]
    assert overlap_join(*stamps, ["k"], ("a", "b"), ("c", "d"), cell=3_600_000_000).count() == 2
    assert overlap_join(left, right.select("k"), ["k"], ("a", "b"), (F.lit(day(0)), F.lit(day(1)))).columns == ["k", "j", "a", "b", "l"]


def test_refused_and_empty(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([("x", 1, 2, 3)], RIGHT)
    assert overlap_join(left, right, ["k"], ("a", "b"), ("c", "d")).count() == 0
    with pytest.raises(ValueError):
        overlap_join(left, left, ["k"], ("a", "b"), ("a", "b"))
    with pytest.raises(ValueError):
        overlap_join(left, right, [], ("a", "b"), ("c", "d"))
    with pytest.raises(TypeError):
        overlap_join(left.withColumn("a", F.lit(1.5)), right, ["k"], ("a", "b"), ("c", "d"))


def test_sweep_of_batches(monkeypatch):
    """Whole batches at once: open intervals go on into the next batch, a record with very many pairs comes out piece by piece."""
    import pyarrow as pa
    monkeypatch.setattr(overlap, "PAIRS", 100)
    rng = random.Random(8)
    events = sorted((k, cell, s, side, s + rng.choice((1, 2, 40)), rng.random() < 0.1, j) for k in "ab" for cell in (0, 1) for side in (0, 1) for j, s in enumerate(rng.choices(range(60), k=150)))
    pick = lambda e, side: e[6] if e[3] == side else None
    kind = pa.schema([("_k0", pa.string()), ("_cell", pa.int64()), ("_start", pa.int64()), ("_end", pa.int64()), ("_side", pa.int32()), ("_carried", pa.bool_()), ("_l0", pa.int64()), ("_r0", pa.int64())])
    rows = [dict(zip(kind.names, (e[0], e[1], e[2], e[4], e[3], e[5], pick(e, 0), pick(e, 1)))) for e in events]
    want = sorted((a[6], b[6]) if a[3] == 0 else (b[6], a[6]) for i, a in enumerate(events) for b in events[i + 1:] if a[:2] == b[:2] and a[3] != b[3] and not b[5] and b[2] < a[4])
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_pylist(rows[i:i + size], kind) for i in range(0, len(rows), size)]
        out = list(overlap._sweep(iter(batches), 1, (["x"], ["y"])))
        assert all(b.num_rows <= 100 for b in out)
        assert sorted((r["x"], r["y"]) for b in out for r in b.to_pylist()) == want and len(want) > 5000
