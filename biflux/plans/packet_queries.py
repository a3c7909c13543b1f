"""Registered queries over packet tables."""

from pyspark.sql import functions as F

from biflux.functions.xxh32 import P1, P2, P3, P4, P5
from biflux.operators import packets as pk, synth
from biflux.plans.views import cte, view

# The star-schema table has no unique packet key; rows equal in all these columns are interchangeable.
ORDER = ["ts_ns", "flow_id", "seq", "size"]
ARRIVAL = ["flow_id", "seq", "ts_ns", "size"]
_O, _A = ", ".join(ORDER), ", ".join(ARRIVAL)


def _packets(spark, sf_dir):
    return view(spark, sf_dir, "packets")


def _meter(spark, sf_dir):
    # All packets of a flow agree on the forward addresses.
    return pk.meter(_packets(spark, sf_dir))


def _desired(spark, sf_dir):
    profile = view(spark, sf_dir, "profile")
    result = pk.desired_vs_metered(profile, _meter(spark, sf_dir))
    return result.withColumn("mean_diff", F.round("mean_diff", 6))


_TURN = "CASE WHEN {s} THEN {a} ELSE {b} END"
def _fragmented(spark, sf_dir):
    """Packets of which the later ones of a flow are fragments, with ids that are used again and ends before beginnings."""
    later = F.col("seq") > 2
    return _packets(spark, sf_dir).withColumns({
        "frag_flag": F.when(~later, "none").when((F.floor(F.col("size") / 40) + F.col("seq")) % 3 == 0, "last").otherwise("more"),
        "frag_id": F.when(later, 7 + F.col("seq") % 2).otherwise(0).cast("long")})


_BIFLOW_SQL = {
    "cut": """SELECT * REPLACE (CASE WHEN seq <= 2 THEN 'none' WHEN (size // 40 + seq) % 3 = 0 THEN 'last' ELSE 'more' END AS frag_flag,
        CAST(CASE WHEN seq > 2 THEN 7 + seq % 2 ELSE 0 END AS BIGINT) AS frag_id) FROM packets""",
    "marked": """SELECT *, coalesce(sum(CASE frag_flag WHEN 'last' THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, dst_ip, l3_proto, frag_id ORDER BY ts_ns, seq, frag_flag = 'last', size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM cut WHERE frag_flag <> 'none'""",
    "whole": """SELECT ts_ns, src_ip, dst_ip, src_port, dst_port, l3_proto, l4_proto, size, 1 AS packets, vlan_id AS v1, vlan_id AS v2,
        0 AS fragmented, CASE WHEN size > 512 THEN 1 ELSE 0 END AS over_min_size FROM cut WHERE frag_flag = 'none'""",
    "frags": """SELECT min(ts_ns) AS ts_ns, src_ip, dst_ip, any_value(src_port) AS src_port, any_value(dst_port) AS dst_port, l3_proto,
        any_value(l4_proto) AS l4_proto, sum(size) AS size, count(*) AS packets, min(vlan_id) AS v1, max(vlan_id) AS v2,
        count(*) FILTER (frag_flag = 'last') AS fragmented, count(*) FILTER (frag_flag = 'last') AS over_min_size,
        count(*) FILTER (frag_flag = 'more') AS more, frag_id FROM marked GROUP BY src_ip, dst_ip, l3_proto, frag_id, session""",
    "parts": "SELECT * FROM whole UNION ALL SELECT * EXCLUDE (more, frag_id) FROM frags WHERE more > 0 AND fragmented > 0",
    "keyed": """SELECT *, src_ip > dst_ip AS swap FROM parts""",
    "flows": """SELECT least(src_ip, dst_ip) AS a_ip, greatest(src_ip, dst_ip) AS b_ip, CASE WHEN swap THEN dst_port ELSE src_port END AS a_port,
        CASE WHEN swap THEN src_port ELSE dst_port END AS b_port, l3_proto, l4_proto, min(ts_ns) AS t1, max(ts_ns) AS t2,
        arg_min(swap, (ts_ns, swap)) AS s, coalesce(sum(packets) FILTER (NOT swap), 0) AS p0, coalesce(sum(packets) FILTER (swap), 0) AS p1,
        coalesce(sum(size) FILTER (NOT swap), 0) AS b0, coalesce(sum(size) FILTER (swap), 0) AS b1, min(v1) AS v1, max(v2) AS v2,
        sum(fragmented) AS fragmented, sum(over_min_size) AS over_min_size FROM keyed GROUP BY ALL""",
}


def _biflows_sql() -> str:
    def turn(a: str, b: str) -> str:
        return f"CASE WHEN s THEN {a} ELSE {b} END"
    return cte("packets", **_BIFLOW_SQL) + f"""SELECT {turn('b_ip', 'a_ip')} AS src_ip, {turn('a_ip', 'b_ip')} AS dst_ip,
      {turn('b_port', 'a_port')} AS src_port, {turn('a_port', 'b_port')} AS dst_port, l3_proto, l4_proto, t1 // 1000000 AS start_time,
      t2 // 1000000 AS end_time, CAST({turn('p1', 'p0')} AS BIGINT) AS packets, CAST({turn('b1', 'b0')} AS BIGINT) AS bytes,
      CAST({turn('p0', 'p1')} AS BIGINT) AS packets_rev, CAST({turn('b0', 'b1')} AS BIGINT) AS bytes_rev, CAST(fragmented AS BIGINT) AS fragmented,
      CAST(over_min_size AS BIGINT) AS over_min_size, CASE WHEN v1 <> v2 THEN 'different vlan ids' END AS error FROM flows"""


def _compare_biflows(spark, sf_dir):
    """Metered flows against the profile: turned around, with a few counters changed and a few rows gone."""
    left = _meter(spark, sf_dir)
    right = left.where("flow_id % 50 <> 0").select(
        F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("dst_port").alias("src_port"),
        F.col("src_port").alias("dst_port"), "l3_proto", "l4_proto",
        (F.col("packets_rev") + F.when(F.col("flow_id") % 40 == 0, 1).otherwise(0)).alias("packets"), F.col("bytes_rev").alias("bytes"),
        F.col("packets").alias("packets_rev"), F.col("bytes").alias("bytes_rev"))
    return pk.compare_biflows(left, right).groupBy("outcome").agg(F.count("*").alias("flows"))


def _violations(spark, sf_dir):
    return pk.order_violations(_packets(spark, sf_dir), ARRIVAL).select(*ARRIVAL, "previous_ns")


def _rebase(spark, sf_dir):
    return pk.rebase_to_first(_packets(spark, sf_dir), ARRIVAL).select("flow_id", "seq", "size", "ts_ns")


def _position(spark, sf_dir):
    return pk.with_position(_packets(spark, sf_dir), ORDER).select(*ORDER, "position")


def _pacing(kind, value):
    def run(spark, sf_dir):
        return pk.pacing_schedule(_packets(spark, sf_dir), kind, value, ORDER).select("flow_id", "seq", "size", "departure_ns")
    return run


def _queue_share(spark, sf_dir):
    return pk.queue_share(_packets(spark, sf_dir), 8)


def _mul_sql(x: str, p: int) -> str:
    return f"CAST(CAST({x} AS HUGEINT) * {p} % 4294967296 AS BIGINT)"


def _rotl_sql(x: str, r: int) -> str:
    return f"((({x}) << {r}) % 4294967296 + (({x}) >> {32 - r}))"


def _word_sql(i: int) -> str:
    return "CAST('0x' || " + " || ".join(f"substr(ip, {8 * i + 2 * b + 1}, 2)" for b in (3, 2, 1, 0)) + " AS BIGINT)"


_LANES = [(P1 + P2) % (1 << 32), P2, 0, (1 << 32) - P1]
_HASH_SQL = {
    "ips": "SELECT DISTINCT unnest([src_ip, dst_ip]) AS ip FROM packets",
    "h0": "SELECT ip, length(ip) = 32 AS v6, " + ", ".join(
        f"CASE WHEN length(ip) = 32 OR {i} = 0 THEN {_word_sql(i)} ELSE 0 END AS k{i}" for i in range(4)) + " FROM ips",
    "h1": f"SELECT *, ({_mul_sql('k0', P3)} + {P5} + 4) % 4294967296 AS s, " + ", ".join(
        f"({_mul_sql(f'k{i}', P2)} + {_LANES[i]}) % 4294967296 AS a{i}" for i in range(4)) + " FROM h0",
    "h2": f"SELECT ip, v6, {_mul_sql(_rotl_sql('s', 17), P4)} AS s, " + ", ".join(
        f"{_mul_sql(_rotl_sql(f'a{i}', 13), P1)} AS a{i}" for i in range(4)) + " FROM h1",
    "h3": f"""SELECT ip, CASE WHEN v6 THEN ({_rotl_sql('a0', 1)} + {_rotl_sql('a1', 7)} + {_rotl_sql('a2', 12)} + {_rotl_sql('a3', 18)} + 16) % 4294967296
        ELSE s END AS h FROM h2""",
    "h4": f"SELECT ip, {_mul_sql('xor(h, h >> 15)', P2)} AS h FROM h3",
    "h5": f"SELECT ip, {_mul_sql('xor(h, h >> 13)', P3)} AS h FROM h4",
    "hashes": "SELECT ip, xor(h, h >> 16) AS h FROM h5",
    "queued": "SELECT CAST(xor(a.h, b.h) % 8 AS INTEGER) AS queue, size FROM packets JOIN hashes a ON src_ip = a.ip JOIN hashes b ON dst_ip = b.ip",
}


def _queues(spark, sf_dir):
    """One row per output queue, as a replay prints them."""
    queued = pk.with_queue(_packets(spark, sf_dir), 8)
    return queued.groupBy("queue").agg(
        F.count("*").alias("packets"), F.sum("size").alias("bytes"),
        F.count_if(F.col("size") > 1600).alias("failed_packets"), F.count_if(F.col("size") < 60).alias("upscaled_packets"),
        F.floor(F.min("ts_ns") / 1_000_000).alias("start_ms"), F.floor(F.max("ts_ns") / 1_000_000).alias("end_ms"))


def _rewrite(spark, sf_dir):
    changed = pk.rewrite_link_layer(pk.scale_packet_times(_packets(spark, sf_dir), 0.5), dst_mac="AA:BB:00:11:22:33", vlan_id=7, mtu=1518)
    return changed.select("flow_id", "seq", "size", "ts_ns", "vlan_id", "dst_mac", "error")


def _plan(max_gap=None):
    def run(spark, sf_dir):
        return synth.plan_packets(view(spark, sf_dir, "profile"), "flow_id", max_gap_s=max_gap, seed=5)
    return run


def _plan_meter(spark, sf_dir):
    """What every plan must keep: packets per direction, first and last time, bytes within the size bounds."""
    plan = _plan()(spark, sf_dir)
    forward = F.col("dir") == "F"
    return plan.groupBy("flow_id").agg(
        F.count_if(forward).alias("packets"), F.count_if(~forward).alias("packets_rev"),
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        F.sum(F.when(forward, F.col("size")).otherwise(0)).alias("bytes"), F.sum(F.when(forward, 0).otherwise(F.col("size"))).alias("bytes_rev"))


def _clamped(packets: str, octets: str) -> str:
    return f"CASE WHEN {packets} = 0 THEN 0 ELSE least(greatest({octets}, {packets} * 64), {packets} * 1514) END"


def _plan_gaps(spark, sf_dir):
    """Longest gap per flow stays within 20 s, the end is kept where the gaps allow it."""
    plan = synth.plan_packets(view(spark, sf_dir, "profile"), "flow_id", max_gap_s=20, seed=5)
    spans = plan.groupBy("flow_id").agg(F.count("*").alias("packets"), (F.max("ts_ns") - F.min("ts_ns")).alias("span_ns"))
    return spans


def _payload(spark, sf_dir):
    profile = view(spark, sf_dir, "profile").withColumn("l4_proto", F.when(F.col("flow_id") % 11 == 0, 1).otherwise(F.col("l4_proto")))
    kind = synth.payload_class(5, F.col("flow_id"), tls_probability=0.0)
    return profile.groupBy("l4_proto", kind.alias("payload")).agg(F.count("*").alias("flows"))


def _impossible(spark, sf_dir):
    """Every 13th flow turned around in time, all others one ms longer."""
    turned = F.col("flow_id") % 13 == 0
    faulty = view(spark, sf_dir, "profile").select(
        "flow_id", "packets", "packets_rev", F.when(turned, F.col("end_time")).otherwise(F.col("start_time")).alias("start_time"),
        F.when(turned, F.col("start_time")).otherwise(F.col("end_time") + 1).alias("end_time"))
    return synth.impossible_flows(faulty).select("flow_id", "error")


_ENCAPS = [("vlan", 0.25), ("mpls", 0.5)]


def _encapsulation(spark, sf_dir):
    profile = view(spark, sf_dir, "profile")
    return profile.select("flow_id", synth.encapsulation(_ENCAPS, 5, F.col("flow_id")).alias("encapsulation"))


def _addresses(spark, sf_dir):
    rows = view(spark, sf_dir, "profile").select("flow_id")
    return synth.unrepeated_addresses(rows, "flow_id", ["10.0.0.0/8", "172.16.0.0/12"], seed=3).agg(
        F.count("*").alias("flows"), F.count_distinct("ip").alias("addresses"),
        F.count_if(F.col("ip").between("0a000000", "0affffff")).alias("first_range"),
        F.count_if(F.col("ip").between("ac100000", "ac1fffff")).alias("second_range"))


def _split_amount(spark, sf_dir):
    rows = view(spark, sf_dir, "profile").withColumns({"n": F.col("packets") + F.col("packets_rev"), "total": F.col("bytes") + F.col("bytes_rev")})
    parts = synth.split_amount(rows, "flow_id", "total", "n", 60, 1500, seed=2)
    return parts.groupBy("flow_id").agg(
        F.count("*").alias("items"), F.sum("value").alias("total"), (F.min("value") >= 60).alias("above"), (F.max("value") <= 1500).alias("below"))


QUERIES = {
    "packet_meter": (_meter, cte("packets") + """SELECT flow_id, any_value(CASE WHEN dir = 'F' THEN src_ip ELSE dst_ip END) AS src_ip,
        any_value(CASE WHEN dir = 'F' THEN dst_ip ELSE src_ip END) AS dst_ip,
        coalesce(min(ts_ns) FILTER (dir = 'F') / 1e6, 0) AS start_time, coalesce(max(ts_ns) FILTER (dir = 'F') / 1e6, 0) AS end_time,
        coalesce(min(ts_ns) FILTER (dir = 'R') / 1e6, 0) AS start_time_rev, coalesce(max(ts_ns) FILTER (dir = 'R') / 1e6, 0) AS end_time_rev,
        any_value(l3_proto) AS l3_proto, any_value(l4_proto) AS l4_proto, any_value(CASE WHEN dir = 'F' THEN src_port ELSE dst_port END) AS src_port,
        any_value(CASE WHEN dir = 'F' THEN dst_port ELSE src_port END) AS dst_port, count(*) FILTER (dir = 'F') AS packets,
        CAST(coalesce(sum(size) FILTER (dir = 'F'), 0) AS BIGINT) AS bytes, count(*) FILTER (dir = 'R') AS packets_rev,
        CAST(coalesce(sum(size) FILTER (dir = 'R'), 0) AS BIGINT) AS bytes_rev FROM packets GROUP BY flow_id"""),
    "desired_vs_metered": (_desired, cte("packets", "profile", m="""SELECT flow_id, count(*) AS p, CAST(sum(size) AS BIGINT) AS b FROM packets GROUP BY flow_id""",
        j="""SELECT packets + packets_rev AS dp, bytes + bytes_rev AS db, coalesce(p, 0) AS mp, coalesce(b, 0) AS mb FROM profile LEFT JOIN m USING (flow_id)""") + """
        SELECT 'packets' AS item, CAST(sum(dp) AS BIGINT) AS desired, CAST(sum(mp) AS BIGINT) AS generated,
          CAST(abs(sum(dp) - sum(mp)) AS DOUBLE) / CAST(sum(dp) AS DOUBLE) AS total_diff, round(avg(CASE WHEN dp = 0 THEN 0 ELSE abs(dp - mp)::DOUBLE / dp END), 6) AS mean_diff FROM j
        UNION ALL SELECT 'bytes', CAST(sum(db) AS BIGINT), CAST(sum(mb) AS BIGINT), CAST(abs(sum(db) - sum(mb)) AS DOUBLE) / CAST(sum(db) AS DOUBLE),
          round(avg(CASE WHEN db = 0 THEN 0 ELSE abs(db - mb)::DOUBLE / db END), 6) FROM j"""),
    "packets_to_biflows": (lambda s, d: pk.packets_to_biflows(_fragmented(s, d))[0], _biflows_sql()),
    "broken_fragments": (lambda s, d: pk.packets_to_biflows(_fragmented(s, d))[1], cte("packets", **{k: _BIFLOW_SQL[k] for k in ("cut", "marked", "frags")}) + """
        SELECT src_ip, dst_ip, frag_id, ts_ns, CASE WHEN fragmented = 0 THEN 'unmatched fragments left' ELSE 'fragment without a beginning' END AS error
        FROM frags WHERE more = 0 OR fragmented = 0"""),
    "compare_biflows": (_compare_biflows, cte("packets", keys="SELECT DISTINCT flow_id FROM packets") + """
        SELECT CASE WHEN flow_id % 50 = 0 THEN 'left_only' WHEN flow_id % 40 = 0 THEN 'different' ELSE 'swapped' END AS outcome, count(*) AS flows
        FROM keys GROUP BY 1"""),
    "packet_position": (_position, cte("packets") + f"SELECT {_O}, row_number() OVER (ORDER BY {_O}) - 1 AS position FROM packets"),
    "order_check": (_violations, cte("packets", seen=f"SELECT {_A}, lag(ts_ns) OVER (ORDER BY {_A}) AS previous_ns FROM packets") +
                    f"SELECT {_A}, previous_ns FROM seen WHERE previous_ns > ts_ns"),
    "packet_rebase": (_rebase, cte("packets") + f"""SELECT flow_id, seq, size,
        greatest(ts_ns - (SELECT ts_ns FROM packets ORDER BY {_A} LIMIT 1), 0) AS ts_ns FROM packets"""),
    "pacing_mbps": (_pacing("mbps", 2), cte("packets", run=f"""SELECT *, CAST(sum(size) OVER (ORDER BY {_O} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM packets""") +
                    "SELECT flow_id, seq, size, t // 250000 * 1000000000 + (t % 250000) * 1000000000 // 250000 AS departure_ns FROM run"),
    "pacing_pps": (_pacing("pps", 7000), cte("packets", run=f"SELECT *, row_number() OVER (ORDER BY {_O}) AS t FROM packets") +
                   "SELECT flow_id, seq, size, t // 7000 * 1000000000 + (t % 7000) * 1000000000 // 7000 AS departure_ns FROM run"),
    "pacing_multiplier": (_pacing("multiplier", 4), cte("packets") + """SELECT flow_id, seq, size,
        CAST(trunc((ts_ns - (SELECT min(ts_ns) FROM packets)) / 4.0::DOUBLE) AS BIGINT) AS departure_ns FROM packets"""),
    "queue_share": (_queue_share, cte("packets", **_HASH_SQL) + """SELECT queue, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes,
        count(*) / (SELECT count(*) FROM packets) AS packets_share, CAST(sum(size) AS DOUBLE) / (SELECT CAST(sum(size) AS DOUBLE) FROM packets) AS bytes_share
        FROM queued GROUP BY queue"""),
    "run_totals": (lambda s, d: pk.run_totals(_queues(s, d)), cte("packets") + """SELECT count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes,
        count(*) FILTER (size > 1600) AS failed_packets, count(*) FILTER (size < 60) AS upscaled_packets, min(ts_ns) // 1000000 AS start_ms,
        max(ts_ns) // 1000000 AS end_ms, max(ts_ns) // 1000000 - min(ts_ns) // 1000000 AS duration_ms FROM packets"""),
    "rewrite_link_layer": (_rewrite, cte("packets") + """SELECT flow_id, seq, size + 4 AS size, CAST(trunc(ts_ns * 0.5::DOUBLE) AS BIGINT) AS ts_ns, 7 AS vlan_id,
        'aa:bb:00:11:22:33' AS dst_mac, CASE WHEN size + 4 > 1518 THEN 'packet length exceeds MTU' END AS error FROM packets"""),
    "expand_packets": (_plan(), None),
    "plan_totals": (_plan_meter, cte("profile") + f"""SELECT flow_id, packets, packets_rev, start_time * 1000000 AS first_ns,
        CASE WHEN packets + packets_rev = 1 THEN end_time ELSE end_time END * 1000000 AS last_ns, {_clamped('packets', 'bytes')} AS bytes,
        {_clamped('packets_rev', 'bytes_rev')} AS bytes_rev FROM profile WHERE packets + packets_rev > 1
        UNION ALL SELECT flow_id, packets, packets_rev, start_time * 1000000, start_time * 1000000, {_clamped('packets', 'bytes')},
          {_clamped('packets_rev', 'bytes_rev')} FROM profile WHERE packets + packets_rev = 1"""),
    "plan_max_gap": (_plan_gaps, cte("profile") + """SELECT flow_id, packets + packets_rev AS packets,
        least((end_time - start_time) * 1000000, (packets + packets_rev - 1) * 20000000000) AS span_ns FROM profile"""),
    "impossible_flows": (_impossible, cte("profile") + """SELECT flow_id, CASE WHEN flow_id % 13 = 0 AND end_time > start_time THEN 'start is after end'
          ELSE 'one packet, but start differs from end' END AS error FROM profile
        WHERE (flow_id % 13 = 0 AND end_time > start_time) OR (flow_id % 13 <> 0 AND packets + packets_rev = 1)"""),
    "payload_class": (_payload, cte("profile", p="SELECT * REPLACE (CAST(CASE WHEN flow_id % 11 = 0 THEN 1 ELSE l4_proto END AS INTEGER) AS l4_proto) FROM profile",
        c="""SELECT *, (bytes + bytes_rev) // (packets + packets_rev) <= CASE l3_proto WHEN 6 THEN 1.1 * 56 ELSE 1.1 * 36 END AS small FROM p""") + """
        SELECT l4_proto, CASE WHEN l4_proto = 1 THEN CASE WHEN (packets <= 3 OR packets_rev <= 3) AND small THEN 'icmp_random'
            WHEN 1 - least(packets, packets_rev)::DOUBLE / greatest(packets, packets_rev) <= 0.2 THEN 'icmp_echo' WHEN small THEN 'icmp_random' ELSE 'icmp_echo' END
          WHEN l4_proto = 6 AND dst_port = 443 THEN 'tls' WHEN l4_proto = 6 AND dst_port IN (80, 8080) THEN 'http'
          WHEN l4_proto = 17 AND dst_port = 53 THEN 'dns' ELSE 'payload' END AS payload, count(*) AS flows FROM c GROUP BY ALL"""),
    "encapsulation": (_encapsulation, None),
    "unrepeated_addresses": (_addresses, cte("profile") + """SELECT count(*) AS flows, count(*) AS addresses, (count(*) + 1) // 2 AS first_range,
        count(*) // 2 AS second_range FROM profile"""),
    "repeated_flows": (lambda s, d: synth.repeated_flows(view(s, d, "raw_flows").withColumnRenamed("proto", "l4_proto")), cte("raw_flows", k="""
        SELECT least(src_ip, dst_ip) AS a_ip, greatest(src_ip, dst_ip) AS b_ip, CASE WHEN src_ip > dst_ip THEN dst_port ELSE src_port END AS a_port,
          CASE WHEN src_ip > dst_ip THEN src_port ELSE dst_port END AS b_port, proto AS l4_proto FROM raw_flows""") + """
        SELECT a_ip, b_ip, a_port, b_port, l4_proto, count(*) AS rows FROM k GROUP BY ALL HAVING count(*) > 1"""),
    "split_amount": (_split_amount, cte("profile") + """SELECT flow_id, packets + packets_rev AS items, bytes + bytes_rev AS total, true AS above, true AS below
        FROM profile WHERE bytes + bytes_rev BETWEEN (packets + packets_rev) * 60 AND (packets + packets_rev) * 1500"""),
}
