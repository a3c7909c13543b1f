"""Give anonymous profile rows addresses from configured ranges with probabilities."""

import ipaddress
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from biflux.functions.draws import pick, random_hex, uniform
from biflux.functions.ip import network_bounds
from biflux.functions.keys import CANON, with_canonical_key
from biflux.runtime import broadcast_if_small, durable
from biflux.schemas import FlowDataError

MAX_TRIES = 10
_NEAR_ZERO = 1e-6


def parse_ranges(ranges: list[str]) -> list[tuple[str, float]]:
    """``["10.0.0.0/8 30%", "10.1.0.0/16"]`` -> subnets with probabilities; the rest is shared equally."""
    parsed = []
    for text in ranges:
        cidr, _, share = text.strip().partition(" ")
        share = share.strip()
        if share and not share.endswith("%"):
            raise FlowDataError(f"probability of range {text!r} must be written as a percentage")
        parsed.append((str(ipaddress.ip_network(cidr)), int(share[:-1]) / 100 if share else None))
    open_ones = sum(p is None for _, p in parsed)
    given = sum(p for _, p in parsed if p is not None)
    result = [(c, (1 - given) / open_ones if p is None else p) for c, p in parsed]
    if abs(sum(p for _, p in result) - 1) > _NEAR_ZERO:
        raise FlowDataError("range probabilities do not add up to 100%")
    return result


def _template(cidr: str) -> Column:
    """How an address of the subnet is put together: fixed digits, one mixed digit, free digits."""
    first = network_bounds(cidr)[0]
    whole, rest = divmod(ipaddress.ip_network(cidr).prefixlen, 4)
    mixed = whole < len(first)
    return F.struct(
        F.lit(first[:whole]).alias("fixed"),
        F.lit(int(first[whole], 16) if mixed else 0).alias("digit"), F.lit(1 << (4 - rest)).alias("values"),
        F.lit(int(mixed)).alias("mixed"), F.lit(max(len(first) - whole - 1, 0)).alias("free"))


def _fill(template: Column, noise: Column) -> Column:
    digit = template["digit"] + F.conv(F.substring(noise, 32, 1), 16, 10).cast("int") % template["values"]
    return F.concat(
        template["fixed"], F.substring(F.lower(F.hex(digit)), F.lit(1), template["mixed"]),
        F.substring(noise, F.lit(1), template["free"]))


def _draw(rows: DataFrame, ranges4: list[tuple[str, float]], ranges6: list[tuple[str, float]], row_id: str, seed: int) -> DataFrame:
    """Add both addresses. A one-address range takes a random side and gets a peer from anywhere."""
    both = [*ranges4, *ranges6]
    templates = F.array(*[_template(c) for c, _ in both], _template("0.0.0.0/0"), _template("::/0"))
    single = F.array(*[F.lit(ipaddress.ip_network(c).num_addresses == 1) for c, _ in both])
    u = uniform(seed, F.col(row_id), "range")
    is_v4 = F.col("l3_proto") == 4
    index = F.when(is_v4, pick(list(accumulate(p for _, p in ranges4)), u)).otherwise(
        len(ranges4) + pick(list(accumulate(p for _, p in ranges6)), u))
    anywhere = F.when(is_v4, len(both)).otherwise(len(both) + 1)
    placed = rows.withColumn("_i", index).withColumn("_single", single[F.col("_i")])
    source_side = uniform(seed, F.col(row_id), "side") < 0.5
    for side, moves in (("src", ~source_side), ("dst", source_side)):
        at = F.when(F.col("_single") & moves, anywhere).otherwise(F.col("_i"))
        noise = random_hex(seed, F.col(row_id), F.col("try"), side)
        placed = placed.withColumn("_t", templates[at]).withColumn("_n", noise)
        placed = placed.withColumn(f"{side}_ip", _fill(F.col("_t"), F.col("_n")))
    return placed.drop("_i", "_single", "_t", "_n")


def enrich(profile: DataFrame, row_id: str, ipv4_ranges: list[str], ipv6_ranges: list[str], seed: int = 0) -> DataFrame:
    """Add ``src_ip`` and ``dst_ip`` so that no two rows share a direction-free 5-tuple.

    All rows draw at once. The few rows that lose a collision to an earlier draw or a smaller row number draw again, up
    to ten times. The first draw is written once; later passes write only the rows that drew again.
    """
    ranges4, ranges6 = parse_ranges(ipv4_ranges), parse_ranges(ipv6_ranges)
    columns = [c for c in profile.columns if c not in ("src_ip", "dst_ip")]
    key = [*CANON, "l4_proto"]

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        fresh = rows.select(*columns).withColumn("try", F.lit(attempt))
        return with_canonical_key(_draw(fresh, ranges4, ranges6, row_id, seed), tie_on_port=True).drop("swap")

    first = durable(drawn(profile, 0))
    shared = first.groupBy(*key).agg(F.min(row_id).alias("winner"), F.count("*").alias("rows")).where(F.col("rows") > 1)
    losers = durable(first.join(shared, key).where(F.col(row_id) != F.col("winner")).select(row_id))
    kept = first.join(losers, row_id, "left_anti")
    for attempt in range(1, MAX_TRIES):
        if losers.isEmpty():
            return kept.select(*columns, "src_ip", "dst_ip")
        again = durable(drawn(first.join(broadcast_if_small(losers), row_id, "left_semi"), attempt))
        drawn_keys = broadcast_if_small(again.select(*key).distinct())
        taken = kept.join(drawn_keys, key, "left_semi").select(*key).distinct()  # settled rows keep their place
        best = again.groupBy(*key).agg(F.min(row_id).alias("winner"))
        won = durable(again.join(taken, key, "left_anti").join(best, key).where(F.col(row_id) == F.col("winner")).drop("winner").select(again.columns))
        losers = durable(again.select(row_id).join(won, row_id, "left_anti"))
        kept = kept.unionByName(won)
    if losers.isEmpty():
        return kept.select(*columns, "src_ip", "dst_ip")
    raise FlowDataError("unique address pairs not found, a range is too small")
