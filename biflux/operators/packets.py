"""Operators on packet tables: metering, order, pacing, queues, reassembly into biflows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from biflux.functions.keys import CANON, with_canonical_key
from biflux.functions.scalars import diff_ratio, mbps_to_bytes_per_second
from biflux.functions.xxh32 import ip_hash
from biflux.schemas import REPORT_COLUMNS
from biflux.runtime import durable
from biflux.skew import global_scan, keyed_scan

PACKET_ORDER = ["ts_ns", "flow_id", "seq"]
NS = 1_000_000_000
VLAN_HEADER = 4


def meter(packets: DataFrame) -> DataFrame:
    """Packets -> one report row per flow: addresses seen from the forward side, times (ms), counters per direction."""
    forward = F.col("dir") == "F"
    ends = F.when(forward, F.struct("src_ip", "dst_ip", "src_port", "dst_port")).otherwise(
        F.struct(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"),
                 F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port")))
    time = F.col("ts_ns") / 1e6
    zero = F.lit(0.0)
    one = packets.groupBy("flow_id").agg(
        F.min_by(ends, F.struct("ts_ns", "seq")).alias("ends"),
        F.coalesce(F.min(F.when(forward, time)), zero).alias("start_time"),
        F.coalesce(F.max(F.when(forward, time)), zero).alias("end_time"),
        F.coalesce(F.min(F.when(~forward, time)), zero).alias("start_time_rev"),
        F.coalesce(F.max(F.when(~forward, time)), zero).alias("end_time_rev"),
        F.max("l3_proto").alias("l3_proto"), F.max("l4_proto").alias("l4_proto"),
        F.count_if(forward).alias("packets"), F.sum(F.when(forward, F.col("size")).otherwise(0)).alias("bytes"),
        F.count_if(~forward).alias("packets_rev"), F.sum(F.when(forward, 0).otherwise(F.col("size"))).alias("bytes_rev"),
    )
    return one.select("flow_id", "ends.*", *[c for c in one.columns if c not in ("flow_id", "ends")]).select(
        "flow_id", *REPORT_COLUMNS)


def desired_vs_metered(desired: DataFrame, report: DataFrame) -> DataFrame:
    """Totals, difference of the totals and mean difference per flow, for packets and bytes."""
    def total(side: str, what: str) -> Column:
        return F.coalesce(F.col(f"{side}.{what}"), F.lit(0)) + F.coalesce(F.col(f"{side}.{what}_rev"), F.lit(0))

    both = desired.alias("d").join(report.alias("m"), "flow_id", "left").select(
        *[total(s, w).alias(f"{s}_{w}") for s in ("d", "m") for w in ("packets", "bytes")])
    sums = both.agg(*[a for w in ("packets", "bytes") for a in (
        F.sum(f"d_{w}").alias(f"d_{w}"), F.sum(f"m_{w}").alias(f"m_{w}"),
        F.avg(diff_ratio(F.col(f"d_{w}"), F.col(f"m_{w}"))).alias(f"mean_{w}"))])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(w).alias("item"), F.col(f"d_{w}").alias("desired"), F.col(f"m_{w}").alias("generated"),
                 diff_ratio(F.col(f"d_{w}"), F.col(f"m_{w}")).alias("total_diff"), F.col(f"mean_{w}").alias("mean_diff"))
        for w in ("packets", "bytes")])))


def merge_by_time(*tables: DataFrame) -> DataFrame:
    """Packets of several tables in sending order, as one range-partitioned sort."""
    return reduce(DataFrame.unionByName, tables).orderBy(*PACKET_ORDER)


def with_position(packets: DataFrame, order: list[str]) -> DataFrame:
    """Position of each packet in the given total order."""
    return global_scan(packets, order, total={"position": F.lit(1)})


def order_violations(packets: DataFrame, order: list[str]) -> DataFrame:
    """Packets older than the packet before them in arrival order."""
    seen = global_scan(packets, order, lag={"previous_ns": F.col("ts_ns")})
    return seen.where(F.col("previous_ns") > F.col("ts_ns"))


def rebase_to_first(packets: DataFrame, order: list[str]) -> DataFrame:
    """Times relative to the first packet in arrival order; earlier ones become zero."""
    first = packets.agg(F.min_by("ts_ns", F.struct(*order))).scalar()
    return packets.withColumn("ts_ns", F.greatest(F.col("ts_ns") - first, F.lit(0)))


def _tokens_to_ns(tokens: Column, rate: int) -> Column:
    """Nanoseconds that a number of tokens takes, rounded down."""
    scaled, per = tokens.cast("decimal(20,0)") * F.lit(NS).cast("decimal(10,0)"), F.lit(rate).cast("decimal(19,0)")
    return ((scaled - scaled % per) / per).cast("bigint")


def pacing_schedule(packets: DataFrame, kind: str, value: float, order: list[str] | None = None) -> DataFrame:
    """Earliest departure of each packet, ns after the start, under a ``pps``, ``mbps`` or ``multiplier`` limit.

    A packet leaves when its own tokens have come in, after those of all packets before it. The original spacing
    (``multiplier``) needs no running sum.
    """
    order = order or PACKET_ORDER
    if kind == "multiplier":
        return rebase_to_first(packets, order).withColumn("departure_ns", (F.col("ts_ns") / F.lit(float(value))).cast("long"))
    own = F.lit(1).cast("long") if kind == "pps" else F.col("size")
    rate = int(value) if kind == "pps" else int(mbps_to_bytes_per_second(value))
    summed = global_scan(packets, order, total={"tokens_before": own})
    return summed.withColumn("departure_ns", _tokens_to_ns(F.col("tokens_before") + own, rate)).drop("tokens_before")


def with_queue(packets: DataFrame, queues: int) -> DataFrame:
    """Output queue of a packet: XXH32 of both addresses combined by XOR, so both directions share a queue."""
    both = ip_hash(F.col("src_ip")).bitwiseXOR(ip_hash(F.col("dst_ip")))
    return packets.withColumn("queue", (both % queues).cast("int"))


def queue_share(packets: DataFrame, queues: int) -> DataFrame:
    """Packets, bytes and their shares per queue. Packets are counted per pair of addresses, and each different address is
    hashed once."""
    pairs = durable(packets.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes")))
    addresses = pairs.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    hashed = durable(addresses.withColumn("hash", ip_hash(F.col("ip"))))
    for side in ("src", "dst"):
        pairs = pairs.join(hashed.select(F.col("ip").alias(f"{side}_ip"), F.col("hash").alias(f"{side}_hash")), f"{side}_ip")
    queue = (F.col("src_hash").bitwiseXOR(F.col("dst_hash")) % queues).cast("int")
    counted = pairs.groupBy(queue.alias("queue")).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    totals = packets.agg(F.struct(F.count("*").alias("packets"), F.sum("size").alias("bytes"))).scalar()
    return counted.withColumns({f"{c}_share": F.col(c) / totals[c] for c in ("packets", "bytes")})


def run_totals(queues: DataFrame) -> DataFrame:
    """Totals over output queues; only queues that sent something count for the start."""
    active = F.col("bytes") > 0
    return queues.agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
        F.sum("failed_packets").alias("failed_packets"), F.sum("upscaled_packets").alias("upscaled_packets"),
        F.min(F.when(active, F.col("start_ms"))).alias("start_ms"), F.max("end_ms").alias("end_ms"),
    ).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def _reassembled(packets: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Whole packets as partial flows, and fragments without an end or a beginning."""
    whole = packets.where(F.col("frag_flag") == "none").select(
        "ts_ns", "src_ip", "dst_ip", "src_port", "dst_port", "l3_proto", "l4_proto", "size",
        F.lit(1).cast("long").alias("packets"), F.col("vlan_id").alias("vlan_low"), F.col("vlan_id").alias("vlan_high"),
        F.col("mpls_label").alias("mpls_low"), F.col("mpls_label").alias("mpls_high"), F.lit(0).cast("long").alias("fragmented"),
        (F.col("size") > min_size).cast("long").alias("over_min_size"))
    more, last = F.col("frag_flag") == "more", F.col("frag_flag") == "last"
    # A last fragment ends its packet; what follows under the same id is another one.
    owner = ["src_ip", "dst_ip", "l3_proto", "frag_id"]
    pieces = packets.where(F.col("frag_flag") != "none").withColumn("_ends", last.cast("long"))
    pieces = keyed_scan(pieces, owner, ["ts_ns", "seq", "_ends", "size"], {"_piece": F.floor(F.col("ts_ns") / 60_000_000_000)}, total={"_session": F.col("_ends")})
    # Ports and protocol are only known from the first fragment.
    first = F.struct("ts_ns", "seq")
    grouped = pieces.groupBy(*owner, "_session").agg(
        F.min("ts_ns").alias("ts_ns"), F.max(F.when(last, F.col("ts_ns"))).alias("last_ns"),
        *[F.min_by(c, first).alias(c) for c in ("src_port", "dst_port", "l4_proto")],
        F.sum("size").alias("size"), F.count("*").alias("packets"),
        F.min("vlan_id").alias("vlan_low"), F.max("vlan_id").alias("vlan_high"),
        F.min("mpls_label").alias("mpls_low"), F.max("mpls_label").alias("mpls_high"),
        F.count_if(more).alias("more"), F.count_if(last).alias("last"))
    complete = (F.col("last") > 0) & (F.col("more") > 0)
    joined = grouped.where(complete).select(
        "ts_ns", "src_ip", "dst_ip", "src_port", "dst_port", "l3_proto", "l4_proto", "size", "packets",
        "vlan_low", "vlan_high", "mpls_low", "mpls_high", F.col("last").alias("fragmented"), F.col("last").alias("over_min_size"))
    broken = grouped.where(~complete).select(
        "src_ip", "dst_ip", F.col("frag_id"), "ts_ns",
        F.when(F.col("last") == 0, "unmatched fragments left").otherwise("fragment without a beginning").alias("error"))
    return whole.unionByName(joined), broken


def packets_to_biflows(packets: DataFrame, min_size: int = 512) -> tuple[DataFrame, DataFrame]:
    """Packets -> biflows in the direction of the first packet, and the fragments that do not fit together.

    Fragments of one id are read by time: each last one completes the packet of those before it, so an id may be used
    again; a last one without any before it, and fragments that no last one follows, are broken (``ts_ns`` is their first).

    ``error`` marks flows whose packets differ in VLAN or MPLS label.
    """
    parts, broken = _reassembled(packets, min_size)
    keyed = with_canonical_key(parts, tie_on_port=True)
    swap = F.col("swap")

    def directed(column: str, swapped: bool) -> Column:
        return F.sum(F.when(swap if swapped else ~swap, F.col(column)).otherwise(0))

    flows = keyed.groupBy(*CANON, "l3_proto", "l4_proto").agg(
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        F.min_by("swap", F.struct("ts_ns", "swap")).alias("swap"),
        directed("packets", False).alias("p0"), directed("packets", True).alias("p1"),
        directed("size", False).alias("b0"), directed("size", True).alias("b1"),
        F.min("vlan_low").alias("vlan_low"), F.max("vlan_high").alias("vlan_high"),
        F.min("mpls_low").alias("mpls_low"), F.max("mpls_high").alias("mpls_high"),
        F.sum("fragmented").alias("fragmented"), F.sum("over_min_size").alias("over_min_size"))

    def side(own: str, other: str) -> Column:
        return F.when(F.col("swap"), F.col(other)).otherwise(F.col(own))

    return flows.select(
        side("a_ip", "b_ip").alias("src_ip"), side("b_ip", "a_ip").alias("dst_ip"),
        side("a_port", "b_port").alias("src_port"), side("b_port", "a_port").alias("dst_port"), "l3_proto", "l4_proto",
        F.floor(F.col("first_ns") / 1_000_000).alias("start_time"), F.floor(F.col("last_ns") / 1_000_000).alias("end_time"),
        side("p0", "p1").alias("packets"), side("b0", "b1").alias("bytes"),
        side("p1", "p0").alias("packets_rev"), side("b1", "b0").alias("bytes_rev"), "fragmented", "over_min_size",
        F.when(F.col("vlan_low") != F.col("vlan_high"), "different vlan ids")
        .when(F.col("mpls_low") != F.col("mpls_high"), "different mpls labels").alias("error"),
    ), broken


def compare_biflows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Match two biflow tables on the direction-free key: ``same, swapped, different, left_only, right_only``.

    Both tables have unique keys (one row per conversation).
    """
    values = ["src_ip", "dst_ip", "src_port", "dst_port", "packets", "bytes", "packets_rev", "bytes_rev"]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return with_canonical_key(df, tie_on_port=True).select(*CANON, "l3_proto", "l4_proto", F.struct(*values).alias(name))

    key = [*CANON, "l3_proto", "l4_proto"]
    both = keyed(left, "l").join(keyed(right, "r"), key, "full_outer")
    l, r = F.col("l"), F.col("r")
    equal_ips = l["src_ip"] == l["dst_ip"]
    aligned = F.when(equal_ips, l["src_port"] == r["src_port"]).otherwise(l["src_ip"] == r["src_ip"])
    counters = ["packets", "bytes", "packets_rev", "bytes_rev"]
    mirrored = ["packets_rev", "bytes_rev", "packets", "bytes"]
    same = F.struct(*[l[c] for c in counters]) == F.struct(*[r[c] for c in counters])
    turned = F.struct(*[l[c] for c in counters]) == F.struct(*[r[c] for c in mirrored])
    outcome = (
        F.when(l.isNull(), "right_only").when(r.isNull(), "left_only")
        .when(aligned & same, "same").when(~aligned & turned, "swapped").otherwise("different"))
    return both.select(*key, outcome.alias("outcome"))


def rewrite_link_layer(packets: DataFrame, dst_mac: str | None = None, src_mac: str | None = None,
                       vlan_id: int | None = None, mtu: int = 1518) -> DataFrame:
    """Set MAC addresses, insert a VLAN tag (4 bytes more) and mark packets above the MTU."""
    changes = {}
    if src_mac is not None:
        changes["src_mac"] = F.lit(src_mac.lower())
    if dst_mac is not None:
        changes["dst_mac"] = F.lit(dst_mac.lower())
    if vlan_id is not None:
        changes |= {"vlan_id": F.lit(vlan_id), "size": F.col("size") + VLAN_HEADER}
    changed = packets.withColumns(changes) if changes else packets
    return changed.withColumn("error", F.when(F.col("size") > mtu, F.lit("packet length exceeds MTU")))


def scale_packet_times(packets: DataFrame, multiplier: float) -> DataFrame:
    return packets.withColumn("ts_ns", (F.col("ts_ns") * F.lit(float(multiplier))).cast("long"))
