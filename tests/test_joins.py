"""Range join and tolerance match against row-by-row versions."""

import math
import random

import pytest

from biflux.operators import ranges as rg, tolerance as tl


def covered(spark, bounds):
    rows = spark.createDataFrame(bounds, "low string, high string").select("low", "high", rg.cover(rg.F.col("low"), rg.F.col("high")).alias("blocks"))
    return [tuple(r) for r in rows.collect()]


def test_blocks_cover_a_range_exactly(spark):
    rng = random.Random(4)
    bounds = [("0000", "ffff"), ("0000", "0000"), ("ffff", "ffff"), ("0100", "01ff"), ("00ff", "0100"), ("0fff", "1000"), ("1230", "123f"), ("0001", "fffe")]
    for _ in range(200):
        a, b = sorted(rng.randrange(65536) for _ in range(2))
        bounds.append((f"{a:04x}", f"{b:04x}"))
    for low, high, blocks in covered(spark, bounds):
        held = [int(b + x, 16) for b in blocks for x in ([""] if len(b) == 4 else [f"{k:0{4 - len(b)}x}" for k in range(16 ** (4 - len(b)))])]
        assert sorted(held) == list(range(int(low, 16), int(high, 16) + 1)), (low, high, blocks)
    assert [b for _, _, b in covered(spark, [("0a000000", "0affffff"), ("00000000", "ffffffff")])] == [["0a"], [""]]


def addresses(rng, n):
    out = [f"{rng.choice([0x0a000000, 0xc0a80000, 0]) + rng.randrange(600):08x}" for _ in range(n)]
    return out + [f"20010db8{rng.randrange(600):024x}" for _ in range(n)]


@pytest.mark.parametrize("small", [True, False])
def test_hits_and_shares(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(rg, "broadcast_if_small", lambda df: df)
    rng = random.Random(7)
    spans = [("00000000", "ffffffff"), ("0" * 32, "f" * 32), ("0a000005", "0a000001"), ("0a000000", "f" * 32), (None, "0a000000")]
    for _ in range(60):
        low, high = sorted(rng.sample(addresses(rng, 30)[:30], 2))
        spans.append((low, high))
        low, high = sorted(rng.sample(addresses(rng, 30)[30:], 2))
        spans.append((low, high))
    flows = [(rng.choice(pool), rng.choice(pool), rng.randrange(100), rng.randrange(9)) for pool in (addresses(rng, 40)[:40], addresses(rng, 40)[40:]) for _ in range(200)]
    flows += flows[:20] + [(None, "0a000001", 5, 5)]
    ranges = spark.createDataFrame([(i, *s, 0.01 * (i % 5)) for i, s in enumerate(spans)], "range_id long, low string, high string, expected double")
    made = {r.range_id: r for r in rg.range_share(spark.createDataFrame(flows, "src_ip string, dst_ip string, bytes long, bytes_rev long"), ranges).collect()}
    inside = lambda a, s: a is not None and s[0] is not None and len(a) == len(s[0]) == len(s[1]) and s[0] <= a <= s[1]
    hits = {i: [f for f in flows if inside(f[0], s) or inside(f[1], s)] for i, s in enumerate(spans)}
    for i, s in enumerate(spans):
        if s[0] is None:
            continue
        total = sum(len(hits[j]) for j, t in enumerate(spans) if t[0] is not None and len(t[0]) == len(s[0]))
        assert (made[i].flows, made[i].bytes) == (len(hits[i]), sum(f[2] + f[3] for f in hits[i]))
        assert made[i].share == pytest.approx(len(hits[i]) / total) and made[i].passed == (abs(len(hits[i]) / total - 0.01 * (i % 5)) <= 0.01)
    nothing = rg.range_share(spark.createDataFrame([], "src_ip string, dst_ip string, bytes long"), ranges).collect()
    assert all(r.flows == 0 and r.share is None and not r.passed for r in nothing)
    assert rg.range_hits(ranges.select(rg.F.col("low").alias("address")), ranges.limit(0)).count() == 0


COLUMNS = "l3_proto int, l4_proto int, src_port int, dst_port int, start_time double, end_time double, packets long, bytes long, packets_rev long, bytes_rev long"


def agrees(p, r):
    near = lambda a, b: math.isclose(a, b, rel_tol=0.2)
    return p[:2] == r[:2] and r[2] in (0, p[2]) and r[3] in (0, p[3]) and all(map(near, p[4:], r[4:]))


def largest(left, right):
    """Size of a largest match by single augmenting paths."""
    partner = {}

    def place(p, seen):
        for j, r in enumerate(right):
            if j not in seen and agrees(left[p], r):
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = p
                    return True
        return False

    return sum(place(p, set()) for p in range(len(left)))


def test_tolerance_match_is_a_largest_one(spark):
    for seed in range(4):
        rng = random.Random(seed)
        some = lambda ports: (4, rng.choice([6, 17]), rng.choice(ports), rng.choice(ports), rng.choice([0.0, 100.0, 110.0, 118.0]), rng.choice([130.0, 150.0, 170.0]),
                              rng.choice([10, 11, 12]), rng.choice([100, 115, 121, 130, 149, 160]), rng.choice([0, 1]), rng.choice([0, 50, 61]))
        left = [some([5, 6]) for _ in range(70)]
        right = [some([0, 5, 6]) for _ in range(60)] + [left[k] for k in (1, 1, 2)]
        left += [left[1], left[0]]
        found = tl.tolerance_match(
            spark.createDataFrame([(i, *r) for i, r in enumerate(left)], f"flow_id long, {COLUMNS}"),
            spark.createDataFrame([(i, *r) for i, r in enumerate(right)], f"report_id long, {COLUMNS}")).collect()
        pairs = [(r.flow_id, r.report_id) for r in found if r.flow_id is not None and r.report_id is not None]
        assert len(pairs) == largest(left, right) and all(agrees(left[p], right[r]) for p, r in pairs)
        assert sorted(r.flow_id for r in found if r.flow_id is not None) == list(range(len(left)))
        assert sorted(r.report_id for r in found if r.report_id is not None) == list(range(len(right)))


def test_tolerance_match_of_odd_tables(spark):
    row = (4, 6, 1, 2, 0.0, 5.0, 1, 40, 0, 0)
    left = spark.createDataFrame([(1, *row), (2, *row), (3, None, *row[1:])], f"flow_id long, {COLUMNS}")
    right = spark.createDataFrame([(7, *row)], f"report_id long, {COLUMNS}")
    found = {(r.flow_id, r.report_id) for r in tl.tolerance_match(left, right).collect()}
    assert found in ({(1, 7), (2, None), (3, None)}, {(2, 7), (1, None), (3, None)})
    assert {(r.flow_id, r.report_id) for r in tl.tolerance_match(left, right.limit(0)).collect()} == {(1, None), (2, None), (3, None)}
    assert {(r.flow_id, r.report_id) for r in tl.tolerance_match(left.limit(0), right).collect()} == {(None, 7)}


def test_shares_without_a_row_per_hit(spark, monkeypatch):
    """Ranges of one id count as their union, over both versions; no flow is written once per range that holds it."""
    monkeypatch.setattr(rg, "range_hits", lambda *_: pytest.fail("a row per hit"))
    rng = random.Random(3)
    pool = [f"0a0000{rng.randrange(40):02x}" for _ in range(30)] + [f"20010db8{rng.randrange(40):024x}" for _ in range(30)] + [None]
    flows = [(rng.choice(pool), rng.choice(pool), rng.choice([None, 3, 7])) for _ in range(300)]
    spans = []
    for i in range(40):
        for _ in range(i % 5):
            head = rng.choice(["0a0000", "20010db8" + "0" * 22])
            low, high = sorted(rng.randrange(40) for _ in range(2))
            spans.append((i, f"{head}{low:02x}", f"{head}{min(high, low + 8):02x}", 0.0))
    spans += spans[:5] + [(None, "00000000", "ffffffff", 0.0)]
    made = rg.range_share(spark.createDataFrame(flows, "src_ip string, dst_ip string, bytes long"),
                          spark.createDataFrame(spans, "range_id long, low string, high string, expected double")).collect()
    inside = lambda a, i: a is not None and any(s[0] == i and len(a) == len(s[1]) and s[1] <= a <= s[2] for s in spans)
    assert len(made) == len(spans)
    for r in made:
        hits = [f for f in flows if r.range_id is not None and (inside(f[0], r.range_id) or inside(f[1], r.range_id))]
        assert (r.flows, r.bytes) == (len(hits), sum(f[2] or 0 for f in hits))


def _some_rows(rng, ports, n):
    some = lambda: (4, rng.choice([6, 17]), rng.choice(ports[0]), rng.choice(ports[1]), rng.choice([0.0, 100.0, 110.0, 118.0]), rng.choice([130.0, 150.0, 170.0]),
                    rng.choice([10, 11, 12]), rng.choice([-100, 100, 115, 121, 130, 149, 160]), rng.choice([0, 1]), rng.choice([0, 50, 61]))
    return [some() for _ in range(n)]


def test_tolerance_match_solves_bounded_groups_where_they_lie(spark, monkeypatch):
    """Rows without a partner start no search over the whole table if their groups are small, and groups may end anywhere in a chunk."""
    monkeypatch.setattr(tl, "_reached", lambda *_: pytest.fail("a search over the table"))
    for seed, chunk in ((1, 7), (2, 50_000)):
        monkeypatch.setattr(tl, "CHUNK", chunk)
        rng = random.Random(seed)
        left, right = _some_rows(rng, ([5, 6, 7], [1, 2]), 80), _some_rows(rng, ([5, 6, 7], [0, 1]), 50)
        found = tl.tolerance_match(
            spark.createDataFrame([(i, *r) for i, r in enumerate(left)], f"flow_id long, {COLUMNS}"),
            spark.createDataFrame([(i, *r) for i, r in enumerate(right)], f"report_id long, {COLUMNS}")).collect()
        pairs = [(r.flow_id, r.report_id) for r in found if r.flow_id is not None and r.report_id is not None]
        assert len(pairs) == largest(left, right) and all(agrees(left[p], right[r]) for p, r in pairs)
        assert len(found) == len(left) + len(right) - len(pairs)


def test_tolerance_match_of_crowded_groups_joins_on_ports(spark, monkeypatch):
    """With a bound of a few pairs some groups are searched by trees, whose joins have the ports among their keys."""
    monkeypatch.setattr(tl, "CROWD", 60)
    rng = random.Random(5)
    left, right = _some_rows(rng, ([5, 5, 5, 6], [1, 2]), 60), _some_rows(rng, ([5, 5, 5, 6], [0, 1, 2]), 50)
    found = tl.tolerance_match(
        spark.createDataFrame([(i, *r) for i, r in enumerate(left)], f"flow_id long, {COLUMNS}"),
        spark.createDataFrame([(i, *r) for i, r in enumerate(right)], f"report_id long, {COLUMNS}")).collect()
    pairs = [(r.flow_id, r.report_id) for r in found if r.flow_id is not None and r.report_id is not None]
    assert len(pairs) == largest(left, right) and all(agrees(left[p], right[r]) for p, r in pairs)
    assert len(found) == len(left) + len(right) - len(pairs)


def test_shares_broadcast_nothing_that_grows_with_the_ranges(spark):
    """Spark takes blocks of ranges for as few as ranges; a broadcast of them passes through the driver."""
    flows = spark.createDataFrame([("0a000001", "0a000002", 5)], "src_ip string, dst_ip string, bytes long")
    ranges = spark.createDataFrame([(1, "0a000000", "0a00000f", 0.5)], "range_id long, low string, high string, expected double")
    found = rg.range_share(flows, ranges)
    # The other join is with the totals of the two address versions.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2 and plan.count("SortMergeJoin") >= 3
    assert [(r.flows, r.bytes) for r in found.collect()] == [(1, 5)]
