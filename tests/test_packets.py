import ipaddress

import pytest
import xxhash
from pyspark.sql import functions as F

from biflux.functions.xxh32 import ip_hash
from biflux.operators import scenario, synth
from biflux.operators.profile_enrich import enrich, parse_ranges
from biflux.operators.profile_trim import TrimSpec, trim
from biflux.schemas import FlowDataError

PROFILE = "id long, start_time long, end_time long, l3_proto int, l4_proto int, src_port int, dst_port int, packets long, bytes long, packets_rev long, bytes_rev long"


def profile(spark, rows):
    return spark.createDataFrame([(i, s, e, 4, 6, 40000, 443, p, b, pr, br) for i, (s, e, p, b, pr, br) in enumerate(rows)], PROFILE)


def test_hash_is_the_published_one(spark):
    addresses = ["10.0.0.1", "255.255.255.255", "0.0.0.0", "2001:db8::1", "::", "fe80::dead:beef"]
    packed = [ipaddress.ip_address(a).packed for a in addresses]
    df = spark.createDataFrame([(p.hex(),) for p in packed], "ip string").withColumn("h", ip_hash(F.col("ip")))
    assert {r.ip: r.h for r in df.collect()} == {p.hex(): xxhash.xxh32_intdigest(p, 0) for p in packed}


@pytest.mark.parametrize("part", [7, 65536])
def test_plan_keeps_totals_for_any_part_size(spark, part):
    rows = [(0, 90_000, 120, 60_000, 80, 20_000), (5, 5, 1, 100, 0, 0), (0, 1_000_000, 3, 900, 30, 3_000), (10, 500, 0, 0, 2, 200)]
    plan = synth.plan_packets(profile(spark, rows), "id", seed=4, part=part)
    got = {r.id: r for r in plan.groupBy("id").agg(
        F.count_if(F.col("dir") == "F").alias("p"), F.sum(F.when(F.col("dir") == "F", F.col("size")).otherwise(0)).alias("b"),
        F.count_if(F.col("dir") == "R").alias("pr"), F.sum(F.when(F.col("dir") == "R", F.col("size")).otherwise(0)).alias("br"),
        F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"), F.min("size").alias("low"), F.max("size").alias("high")).collect()}
    for i, (s, e, p, b, pr, br) in enumerate(rows):
        r = got[i]
        assert (r.p, r.b, r.pr, r.br) == (p, b, pr, br) and (r.first, r.last) == (s * 10**6, e * 10**6)
        assert r.low >= 64 and r.high <= 1514
    order = plan.orderBy("id", "seq").collect()
    assert all(a.ts_ns <= b.ts_ns for a, b in zip(order, order[1:]) if a.id == b.id)


@pytest.mark.parametrize("part", [5, 65536])
def test_gap_limit(spark, part):
    rows = [(0, 100_000, 30, 9_000, 0, 0), (0, 100_000, 11, 3_300, 0, 0), (0, 100_000, 4, 1_200, 0, 0)]
    plan = synth.plan_packets(profile(spark, rows), "id", max_gap_s=10, seed=1, part=part).orderBy("id", "seq").collect()
    for i, end in ((0, 100), (1, 100), (2, 30)):
        times = [r.ts_ns for r in plan if r.id == i]
        assert times[-1] == end * 10**9 and max(b - a for a, b in zip(times, times[1:])) <= 10 * 10**9 + 1


def test_tasks_follow_the_items_of_the_parts(spark, monkeypatch):
    """Few rows that plan many packets are dealt over as many tasks as the packets call for; the plan stays the same."""
    rows = profile(spark, [(0, 90_000, 300, 60_000, 100, 20_000)] * 6)
    plans = []
    for size in (100, 10_000):
        monkeypatch.setattr(synth, "TASK_ITEMS", size)
        split = synth._parts(rows, "id", F.col("packets") + F.col("packets_rev"), 50)
        assert split.rdd.getNumPartitions() == max(8, 2400 // size)
        plans.append([sorted(map(tuple, found.collect())) for found in (
            synth.plan_packets(rows, "id", seed=4, part=50), synth.split_amount(rows, "id", "bytes", "packets", 60, 1500, part=50))])
    assert plans[0] == plans[1]


def test_size_map():
    sizes = synth.SizeMap.parse({"100-199": 0.5, "64-79": 0.5})
    assert sizes.intervals == ((64, 79, 0.5), (80, 99, 0.0), (100, 199, 0.5))
    for bad in ({"1-5": 0.5, "5-9": 0.5}, {"9-1": 1.0}, {"1-2": 0.0}, {"x": 1.0}):
        with pytest.raises(FlowDataError):
            synth.SizeMap.parse(bad)


def test_draws_do_not_depend_on_partitions(spark):
    rows = [(i * 100, i * 100 + 5000, 5, 900, 2, 300) for i in range(300)]
    spec = TrimSpec(tolerance=5000, main=10_000)
    one, many = (trim(profile(spark, rows).repartition(n), spec, "id", seed=9) for n in (1, 8))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    plans = [synth.plan_packets(profile(spark, rows).repartition(n), "id", seed=9) for n in (1, 8)]
    assert sorted(map(tuple, plans[0].collect())) == sorted(map(tuple, plans[1].collect()))


def test_trim_refuses_a_profile_without_duration(spark):
    spec = TrimSpec(tolerance=10, main=100)
    with pytest.raises(Exception, match="spans no time"):
        trim(profile(spark, [(7, 7, 1, 60, 0, 0), (7, 7, 2, 120, 0, 0)]), spec, "id").collect()
    assert trim(profile(spark, []), spec, "id").collect() == []


def test_enrich_draws_again_and_gives_up(spark):
    rows = profile(spark, [(0, 1, 1, 60, 1, 60)] * 6)
    found = enrich(rows, "id", ["10.0.0.0/30"], ["2001:db8::/32"], seed=1)
    assert found.select(F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"), F.col("src_ip") > F.col("dst_ip")).distinct().count() == 6
    with pytest.raises(FlowDataError):
        enrich(profile(spark, [(0, 1, 1, 60, 1, 60)] * 40), "id", ["10.0.0.0/31"], ["2001:db8::/32"])
    assert parse_ranges(["10.0.0.0/8 30%", "11.0.0.0/8"])[1][1] == pytest.approx(0.7)
    with pytest.raises(FlowDataError):
        parse_ranges(["10.0.0.0/8 30%", "11.0.0.0/8 30%"])


def test_scenario_helpers():
    lists = [{"name": "a", "include": "b"}, {"name": "b", "include": "a"}]
    with pytest.raises(FlowDataError):
        scenario.known_failures(lists, "a")
    segments = scenario.overload_segments("64.0.0.0/8", "4000::/8", 8, 2, 3)
    assert [s.source for s in segments[:4]] == ["64.0.0.0/8", "4000::/8", "65.0.0.0/8", "4100::/8"] and segments[4].source == "70.0.0.0/8"
    assert scenario.bisection_step(0, 1000, 100) == 500 and scenario.bisection_step(0, 90, 100) is None
    assert scenario.extended_ranges(["10.0.0.0/24"], [0, 256], 1024, 2) == ["10.0.0.0/24", "10.0.1.0/24", "10.0.4.0/24", "10.0.5.0/24"]


def test_fragments_of_a_reused_id(spark):
    """(time, flag): an end before any beginning, two packets under one id, a rest without an end."""
    from biflux.operators import packets as pk

    flags = [(1, "last"), (2, "more"), (3, "more"), (4, "last"), (5, "more"), (6, "last"), (7, "last"), (8, "more")]
    rows = [(t * 10**6, t, "0a000001", "0a000002", 5, 6, 4, 17, 100, 0, 0, 9, f) for t, f in flags] + [(10**7, 9, "0a000001", "0a000002", 5, 6, 4, 17, 600, 0, 0, 0, "none")]
    schema = "ts_ns long, seq int, src_ip string, dst_ip string, src_port int, dst_port int, l3_proto int, l4_proto int, size long, vlan_id int, mpls_label int, frag_id long, frag_flag string"
    flows, broken = pk.packets_to_biflows(spark.createDataFrame(rows, schema).repartition(4))
    assert sorted((r.ts_ns // 10**6, r.error) for r in broken.collect()) == [
        (1, "fragment without a beginning"), (7, "fragment without a beginning"), (8, "unmatched fragments left")]
    flow = flows.first()
    assert (flow.packets, flow.bytes, flow.fragmented, flow.over_min_size) == (6, 1100, 2, 3)
    merged = [r.ts_ns for r in pk.merge_by_time(*[spark.createDataFrame([rows[k]], schema).withColumn("flow_id", pk.F.lit(1)) for k in (5, 0, 3)]).collect()]
    assert merged == sorted(merged)
