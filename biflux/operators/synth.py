"""Plan the packets of a profile: directions, sizes, times, addresses and payload classes.

A flow is planned in parts of bounded size. Every total (packets per direction, bytes, duration) is first divided over
the parts in closed form, so parts are independent and a flow with a third of all packets spreads over the cluster.
"""

import ipaddress
from dataclasses import dataclass
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from biflux.functions.draws import draw_bits, pick, uniform
from biflux.functions.ip import network_bounds
from biflux.functions.keys import CANON, with_canonical_key
from biflux.schemas import FlowDataError
from biflux.skew import global_scan

PART = 65_536
#: Items a task sorts at once: a few hundred bytes each, for up to six sorts, stay in memory.
TASK_ITEMS = 4 * PART
# Default packet size intervals (from, to, probability).
DEFAULT_SIZES = [
    (64, 79, 0.2824), (80, 159, 0.073), (160, 319, 0.0115), (320, 639, 0.012), (640, 1279, 0.0092), (1280, 1514, 0.6119),
]


@dataclass(frozen=True)
class SizeMap:
    """Sorted packet size intervals with probabilities adding up to 1; gaps have probability 0."""

    intervals: tuple[tuple[int, int, float], ...]

    @classmethod
    def parse(cls, spec: dict[str, float]) -> "SizeMap":
        """``{"64-79": 0.3, ...}``"""
        found = []
        for text, probability in spec.items():
            pieces = text.split("-")
            if len(pieces) != 2 or not all(p.strip().isdigit() for p in pieces) or int(pieces[0]) > int(pieces[1]):
                raise FlowDataError(f"size range {text!r} is not <from>-<to>")
            if not 0 <= probability <= 1:
                raise FlowDataError(f"probability {probability} of {text!r} is outside 0..1")
            found.append((int(pieces[0]), int(pieces[1]), float(probability)))
        return cls.of(found)

    @classmethod
    def of(cls, intervals: list[tuple[int, int, float]]) -> "SizeMap":
        total = sum(p for *_, p in intervals)
        if total == 0:
            raise FlowDataError("at least one size range needs a probability")
        result: list[tuple[int, int, float]] = []
        for low, high, p in sorted(intervals):
            if result and low <= result[-1][1]:
                raise FlowDataError(f"size range {low}-{high} overlaps with {result[-1][0]}-{result[-1][1]}")
            if result and low > result[-1][1] + 1:
                result.append((result[-1][1] + 1, low - 1, 0.0))
            result.append((low, high, p / total))
        return cls(tuple(result))

    @property
    def smallest(self) -> int:
        return self.intervals[0][0]

    @property
    def largest(self) -> int:
        return self.intervals[-1][1]

    def draw(self, *key) -> Column:
        index = pick(list(accumulate(p for *_, p in self.intervals)), uniform(*key, "interval"))
        bounds = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b, _ in self.intervals])[index]
        return (bounds["low"] + F.floor(uniform(*key, "size") * (bounds["high"] - bounds["low"] + 1))).cast("long")


def _cut(total: Column, done: Column, whole: Column) -> Column:
    """``floor(total * done / whole)`` without overflow; differences of it add up to the total."""
    wide = "decimal(20,0)"
    return F.when(whole > 0, F.floor(total.cast(wide) * done.cast(wide) / whole.cast(wide))).otherwise(0).cast("long")


def _parts(rows: DataFrame, row_id: str, count: Column, part: int) -> DataFrame:
    """One row per part of at most ``part`` items, spread over the cluster by row and part.

    Parts are small, but their items are not: tasks are as many as the counted items call for, so no sort has to spill.
    """
    split = rows.withColumn("n", count).where(F.col("n") > 0)
    items = split.agg(F.sum(F.col("n").cast("double"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(items / TASK_ITEMS))
    split = split.withColumn(
        "part", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))))
    split = split.withColumn("at", F.col("part") * part).withColumn("items", F.least(F.lit(part), F.col("n") - F.col("at")))
    return split.repartition(tasks, row_id, "part")


def _fit_to_total(draw: Column, total: Column, low: Column, high: Column, group) -> Column:
    """Move draws within ``[low, high]`` so that the group adds up to the total (as far as the bounds allow)."""
    n, drawn = F.count(draw).over(group), F.sum(draw).over(group)
    floor, ceiling = n * low, n * high
    down = F.when(drawn > floor, low + (draw - low) * ((F.greatest(total, floor) - floor) / (drawn - floor))).otherwise(low)
    up = F.when(drawn < ceiling, high - (high - draw) * ((ceiling - F.least(total, ceiling)) / (ceiling - drawn))).otherwise(high)
    return F.when(drawn >= total, down).otherwise(up)


def _whole_numbers(value: Column, group, order: str) -> Column:
    """Integers next to real values whose sum is the sum of the values, by rounding the running sum."""
    ordered = group.orderBy(order)
    before, upto = (F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, to)) for to in (-1, 0))
    return (F.round(upto) - F.coalesce(F.round(before), F.lit(0.0))).cast("long")


def plan_packets(
    profile: DataFrame,
    row_id: str,
    sizes: SizeMap | None = None,
    max_gap_s: int | None = None,
    seed: int = 0,
    part: int = PART,
) -> DataFrame:
    """Profile rows (times in ms) -> planned packets ``row_id, seq, ts_ns, dir, size``.

    Exact for every flow: packets per direction, bytes per direction where the size bounds allow them, first packet at
    the start, last at the end unless the gaps would exceed ``max_gap_s`` - then the end moves forward.
    """
    sizes = sizes or SizeMap.of(DEFAULT_SIZES)
    rows = profile.select(row_id, "start_time", "end_time", "packets", "bytes", "packets_rev", "bytes_rev")
    parts = _parts(rows, row_id, F.col("packets") + F.col("packets_rev"), part)
    n, at, items = F.col("n"), F.col("at"), F.col("items")
    duration = (F.col("end_time") - F.col("start_time")) * 1_000_000
    gaps = n - 1
    if max_gap_s is not None:
        duration = F.least(duration, gaps * max_gap_s * 1_000_000_000)
    parts = parts.withColumn("span", duration).withColumns({
        "fwd_before": _cut(F.col("packets"), at, n), "fwd": _cut(F.col("packets"), at + items, n) - _cut(F.col("packets"), at, n),
        "gap_items": F.least(items, gaps - at),
    })
    parts = parts.withColumns({
        "rev_before": at - F.col("fwd_before"), "rev": items - F.col("fwd"),
        "offset": _cut(F.col("span"), at, gaps),
        "budget": _cut(F.col("span"), at + F.col("gap_items"), gaps) - _cut(F.col("span"), at, gaps),
    })
    parts = parts.withColumns({
        f"{d}_bytes": _cut(F.col(b), F.col(f"{d}_before") + F.col(d), F.col(p)) - _cut(F.col(b), F.col(f"{d}_before"), F.col(p))
        for d, p, b in (("fwd", "packets", "bytes"), ("rev", "packets_rev", "bytes_rev"))
    })
    packets = parts.withColumn("i", F.explode_outer(F.sequence(F.lit(0).cast("long"), items - 1))).withColumn("seq", F.col("at") + F.col("i"))
    key = (seed, F.col(row_id), F.col("seq"))
    group = Window.partitionBy(row_id, "part")
    rank = F.row_number().over(group.orderBy(draw_bits(*key, "dir"), "seq"))
    packets = packets.withColumns({"dir": F.when(rank <= F.col("fwd"), "F").otherwise("R"), "draw": sizes.draw(*key)})
    side = Window.partitionBy(row_id, "part", "dir")
    target = F.when(F.col("dir") == "F", F.col("fwd_bytes")).otherwise(F.col("rev_bytes"))
    packets = packets.withColumn("real", _fit_to_total(
        F.col("draw"), target, F.lit(sizes.smallest), F.lit(sizes.largest), side))
    packets = packets.withColumn("size", _whole_numbers(F.col("real"), side, "seq"))
    packets = _with_gaps(packets, key, max_gap_s, group)
    before = F.coalesce(F.sum("gap").over(group.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    within = F.least(F.floor(before), F.col("budget"))
    passed = F.when(F.col("seq") == F.col("n") - 1, F.col("span")).otherwise(F.col("offset") + within)
    return packets.select(row_id, "seq", (F.col("start_time") * 1_000_000 + passed).cast("long").alias("ts_ns"), "dir", "size")


def _with_gaps(packets: DataFrame, key: tuple, max_gap_s: int | None, group) -> DataFrame:
    """Gap after each packet: evenly random cuts of the budget of the part, none above the limit.

    Exponential weights divided by their sum are distributed like the gaps between sorted uniform times. Weights that
    would exceed the limit get exactly the limit, the rest share what is left (largest weights first).
    """
    weight = F.when(F.col("i") < F.col("gap_items"), -F.log(1 - uniform(*key, "gap")) + 1e-12).otherwise(0.0)
    packets = packets.withColumn("w", weight).withColumn("w_all", F.sum("w").over(group))
    if max_gap_s is None:
        return packets.withColumn("gap", F.when(F.col("w_all") > 0, F.col("budget") * F.col("w") / F.col("w_all")).otherwise(0.0))
    limit = F.lit(float(max_gap_s * 1_000_000_000))
    falling = group.orderBy(F.col("w").desc(), "seq")
    packets = packets.withColumns({
        "r": F.row_number().over(falling) - 1,
        "w_before": F.coalesce(F.sum("w").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    })
    left = F.greatest(F.col("w_all") - F.col("w_before"), F.lit(0.0))
    scale = F.when(left > 0, F.greatest(F.col("budget") - F.col("r") * limit, F.lit(0.0)) / left).otherwise(0.0)
    packets = packets.withColumn("full", (F.col("w") > 0) & (scale * F.col("w") >= limit))
    packets = packets.withColumns({
        "full_n": F.sum(F.col("full").cast("int")).over(group), "full_w": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(group),
    })
    rest = F.col("w_all") - F.col("full_w")
    share = F.when(rest > 0, F.greatest(F.col("budget") - F.col("full_n") * limit, F.lit(0.0)) * F.col("w") / rest).otherwise(0.0)
    return packets.withColumn("gap", F.when(F.col("full"), limit).otherwise(F.least(share, limit)))


def impossible_flows(profile: DataFrame) -> DataFrame:
    """Profile rows that no packets can be planned for."""
    n = F.col("packets") + F.col("packets_rev")
    error = (
        F.when(F.col("start_time") > F.col("end_time"), "start is after end")
        .when((n == 1) & (F.col("start_time") != F.col("end_time")), "one packet, but start differs from end"))
    return profile.withColumn("error", error).where(F.col("error").isNotNull())


def split_amount(rows: DataFrame, row_id: str, amount: str, count: str, low: int, high: int, seed: int = 0, part: int = PART) -> DataFrame:
    """Split an amount into ``count`` random values within ``[low, high]`` that add up to it: ``row_id, item, value``."""
    base = rows.select(row_id, amount, count).where(
        (F.col(count) * low <= F.col(amount)) & (F.col(amount) <= F.col(count) * high))
    parts = _parts(base, row_id, F.col(count), part)
    target = _cut(F.col(amount), F.col("at") + F.col("items"), F.col("n")) - _cut(F.col(amount), F.col("at"), F.col("n"))
    items = parts.withColumn("target", target).withColumn(
        "item", F.explode_outer(F.sequence(F.col("at"), F.col("at") + F.col("items") - 1)))
    draw = low + uniform(seed, F.col(row_id), F.col("item"), "split") * (high - low)
    group = Window.partitionBy(row_id, "part")
    items = items.withColumn("draw", draw).withColumn("real", _fit_to_total(
        F.col("draw"), F.col("target"), F.lit(low), F.lit(high), group))
    return items.select(row_id, "item", _whole_numbers(F.col("real"), group, "item").alias("value"))


def unrepeated_addresses(rows: DataFrame, row_id: str, prefixes: list[str], seed: int = 0, out: str = "ip") -> DataFrame:
    """An address per row out of several prefixes of one IP version, without repeats until a prefix is used up.

    Rows are numbered; a prefix maps its numbers with an odd multiplier modulo its (low 32 bits of) size, which is a
    bijection, and counts the upper host bits on from there.
    """
    numbered = global_scan(rows, [row_id], total={"_no": F.lit(1).cast("long")})
    k, result = F.floor(F.col("_no") / len(prefixes)), None
    for i, cidr in enumerate(prefixes):
        network = ipaddress.ip_network(cidr)
        first = network_bounds(cidr)[0]
        bits = network.max_prefixlen - network.prefixlen
        low_bits = min(bits, 32)
        size = 1 << low_bits
        step = (0x9E3779B1 + 2 * seed) % size | 1
        moved = (k % size * (step % (1 << 31) | 1) + seed * 7919) % size
        base = int(network.network_address)
        head = format(base >> 32, f"0{len(first) - 8}x") if len(first) > 8 else ""
        low = F.lpad(F.lower(F.hex(F.lit(base & 0xFFFFFFFF) + moved)), 8, "0")
        if head:
            carried = (int(head[-8:], 16) + F.floor(k / size)) % (1 << 32) if bits > 32 else F.lit(int(head[-8:], 16))
            low = F.concat(F.lit(head[:-8]), F.lpad(F.lower(F.hex(carried)), 8, "0"), low)
        picked = F.col("_no") % len(prefixes) == i
        result = F.when(picked, low) if result is None else result.when(picked, low)
    return numbered.withColumn(out, result).drop("_no")


def repeated_flows(flows: DataFrame) -> DataFrame:
    """Direction-free 5-tuples (ties broken by port) used more than once."""
    return with_canonical_key(flows, tie_on_port=True).groupBy(*CANON, "l4_proto").agg(
        F.count("*").alias("rows")).where(F.col("rows") > 1)


def encapsulation(variants: list[tuple[str, float]], *key) -> Column:
    """Name of the encapsulation chosen by probability; what is left over is ``none``."""
    return F.array(*[F.lit(n) for n, _ in variants], F.lit("none"))[
        pick([*accumulate(p for _, p in variants), 1.0], uniform(*key, "encapsulation"))]


# Header sizes in bytes (ICMP, ICMPv6, IPv4, IPv6, UDP).
ICMP, ICMPV6, IPV4, IPV6, UDP = 8, 4, 20, 40, 8


def payload_class(
    *key, always_tls: list[tuple[int, int]] = ((443, 443),), never_tls: list[tuple[int, int]] = ((80, 80),),
    tls_probability: float = 0.0, enabled: frozenset[str] = frozenset({"tls", "http", "dns"}),
) -> Column:
    """tls, http, dns, payload or icmp_echo / icmp_random by protocol, ports and counters of a profile row."""
    l4, port = F.col("l4_proto"), F.col("dst_port")

    def within(ranges) -> Column:
        result = F.lit(False)
        for low, high in ranges:
            result = result | port.between(low, high)
        return result

    tls = F.when(within(always_tls), True).when(within(never_tls), False).otherwise(uniform(*key, "tls") < tls_probability)
    fwd, rev = F.col("packets"), F.col("packets_rev")
    per_packet = F.coalesce(F.floor((F.col("bytes") + F.col("bytes_rev")) / F.nullif(fwd + rev, F.lit(0))), F.lit(0))
    unreachable = F.when(F.col("l3_proto") == 6, 1.1 * (ICMPV6 + 4 + IPV6 + UDP)).otherwise(1.1 * (ICMP + IPV4 + UDP))
    imbalance = F.when(fwd + rev > 0, 1 - F.least(fwd, rev) / F.greatest(fwd, rev)).otherwise(1.0)
    small = per_packet <= unreachable
    few = (fwd <= 3) | (rev <= 3)
    icmp = F.when(small & (few | (imbalance > 0.2)), "icmp_random").otherwise("icmp_echo")
    return (
        F.when(l4.isin(1, 58), icmp)
        .when((l4 == 6) & F.lit("tls" in enabled) & tls, "tls")
        .when((l4 == 6) & F.lit("http" in enabled) & port.isin(80, 8080), "http")
        .when((l4 == 17) & F.lit("dns" in enabled) & (port == 53), "dns")
        .otherwise("payload"))
