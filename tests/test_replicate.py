import pytest
from pyspark.sql import Row, functions as F

from biflux.functions.ip import ip_format, ip_parse
from biflux.operators.replicate import ReplicationPlan, merge_across_loops, parse_loop_only, replicate, replicate_reference
from biflux.schemas import FLOW_KEY, UNIFLOW, FlowDataError


def flows(spark, rows):
    table = spark.createDataFrame([(s, e, 17, a, "81.2.248.189", 60426, 321, p, b) for s, e, a, p, b in rows], UNIFLOW)
    return table.withColumns({c: ip_parse(F.col(c)) for c in ("src_ip", "dst_ip")})


SOURCE = [(0, 40000, "10.0.0.1", 4, 304), (20000, 40000, "10.0.0.2", 5, 305), (0, 30000, "10.0.0.3", 6, 306)]
LOOPED = {"units": [{"srcip": "None"}], "loop": {"srcip": "addOffset(1)"}}
MERGED = {
    (0, 40000, "10.0.0.1", 4, 304), (20000, 80000, "10.0.0.2", 9, 609), (0, 30000, "10.0.0.3", 6, 306),
    (60000, 120000, "10.0.0.3", 9, 609), (40000, 70000, "10.0.0.4", 6, 306), (100000, 120000, "10.0.0.4", 5, 305),
    (80000, 110000, "10.0.0.5", 6, 306),
}


def as_set(df):
    return {tuple(r) for r in df.select("start_time", "end_time", ip_format(F.col("src_ip")), "packets", "bytes").collect()}


def indexed(spark):
    return flows(spark, SOURCE).withColumn("idx", F.conv(F.substring("src_ip", 8, 1), 16, 10).cast("long"))


def test_merge_across_loops_keeps_long_gaps(spark):
    assert as_set(replicate_reference(indexed(spark), LOOPED, 3, merge=True, inactive_timeout=29, index="idx")) == MERGED


def test_hot_key_gives_the_same(spark):
    copied = replicate(indexed(spark), ReplicationPlan.from_config(LOOPED), 3)
    heavy = [Row(*FLOW_KEY)(*r) for r in copied.select(*FLOW_KEY).distinct().collect()]
    assert as_set(merge_across_loops(copied, "idx", 29, heavy=heavy)) == MERGED


def test_equal_copies_in_a_loop_merge(spark):
    result = replicate_reference(flows(spark, SOURCE), {"units": [{"srcip": "None"}, {"dstip": "None"}]}, 1)
    assert as_set(result) == {(s, e, a, 2 * p, 2 * b) for s, e, a, p, b in SOURCE}


def test_ipv6_moves_in_its_first_32_bits(spark):
    v6 = flows(spark, [(0, 10, "2001:db8::1", 1, 60)])
    assert as_set(replicate_reference(v6, {"units": [{"srcip": "addConstant(1)"}]}, 1)) == {(0, 10, "2001:db9::1", 1, 60)}


def test_speed(spark):
    result = replicate_reference(flows(spark, SOURCE), LOOPED, 2, speed=2.0)
    assert {(s, e) for s, e, *_ in as_set(result)} == {(0, 20000), (10000, 20000), (0, 15000), (20000, 40000), (30000, 40000), (20000, 35000)}


@pytest.mark.parametrize("config", [
    {"units": [{"srcip": "addCounter(0, 1)"}]}, {"units": [], "other": 1}, {"units": [{"dstip": "rotate(2)"}]}])
def test_bad_config(config):
    with pytest.raises(FlowDataError):
        ReplicationPlan.from_config(config)


def test_counter_is_fine_in_ignored_loops():
    plan = ReplicationPlan.from_config({"units": [{"srcip": "None"}, {"srcip": "addCounter(0, 1)", "loopOnly": 1}]}, [1])
    assert len(plan.units) == 1 and set(plan.copies(3)) == {(0, 0, 0), (2, 0, 0)}


def test_loop_only():
    assert parse_loop_only("All") == frozenset() and parse_loop_only(2) == {2} and parse_loop_only([1, "3-5"]) == {1, 3, 4, 5}


def test_merge_without_an_index_does_not_depend_on_partitions(spark):
    import random

    rng = random.Random(3)
    rows = [(s := rng.randrange(0, 400_000, 1000), s + rng.randrange(90_000), 6, f"0a0000{rng.randrange(3):02x}", "c0a80001", 5, 6, rng.randrange(9), rng.randrange(99)) for _ in range(300)]
    flows = spark.createDataFrame(rows + rows[:20], UNIFLOW)
    plan = {"units": [{"srcip": "None"}, {"srcip": "addConstant(1)"}], "loop": {"srcip": "addOffset(1)"}}
    found = [sorted(map(tuple, replicate_reference(flows.repartition(n), plan, 3, merge=True, inactive_timeout=20).collect())) for n in (1, 7, 64)]
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) < 3 * 2 * 320
