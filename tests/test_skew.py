import random

from pyspark.sql import Row, functions as F

from biflux.skew import global_scan, heavy_keys, keyed_scan


def rows(n=2000):
    rng = random.Random(3)
    return [(rng.choice(["hot"] * 4 + ["a", "b", "c"]), i, rng.randrange(100)) for i in range(n)]


def scans(spark, heavy):
    df = spark.createDataFrame(rows(), "k string, pos long, v long").repartition(7)
    return {(r.k, r.pos): (r.last, r.run, r.top) for r in keyed_scan(
        df, ["k"], ["pos"], {"piece": F.floor(F.col("pos") / 50)}, lag={"last": F.col("v")}, total={"run": F.col("v")},
        peak={"top": F.col("v")}, heavy=heavy).collect()}


def test_pieces_equal_one_window(spark):
    plain = scans(spark, [])
    assert plain == scans(spark, [Row(k="hot"), Row(k="a")])
    before = [v for k, p, v in rows() if k == "hot"]
    last = max(p for k, p, v in rows() if k == "hot")
    assert plain["hot", last] == (before[-2], sum(before[:-1]), max(before[:-1]))


def test_heavy_keys_are_found(spark):
    df = spark.createDataFrame(rows(), "k string, pos long, v long")
    assert heavy_keys(df, ["k"], min_rows=600) == [Row(k="hot")]
    assert heavy_keys(df, ["k"]) == []


def test_global_scan(spark):
    df = spark.createDataFrame(rows(), "k string, pos long, v long").repartition(5)
    got = global_scan(df, ["pos"], lag={"last": F.col("v")}, total={"run": F.col("v")}, pieces=9).orderBy("pos").collect()
    values = [v for _, _, v in rows()]
    assert [r.last for r in got] == [None, *values[:-1]]
    assert [r.run for r in got] == [sum(values[:i]) for i in range(len(values))]


def test_null_before_stays_null_in_pieces(spark):
    """The value carried from an earlier piece counts only for the first row of a piece."""
    from biflux import skew

    rows = spark.createDataFrame([("k", t, None if t % 3 == 1 else t) for t in range(12)], "k string, t int, v int")
    pieced = rows.withColumn("p", F.floor(F.col("t") / 4))
    got = {r.t: r.before for r in skew._pieced(pieced, ["k"], ["t"], ["p"], {"before": F.col("v")}, {}, {}).collect()}
    assert got == {t: None if t == 0 or (t - 1) % 3 == 1 else t - 1 for t in range(12)}
