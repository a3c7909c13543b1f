"""Flow tables derived from the star-schema test tables, as DataFrames and as the same SQL for the oracle.

One ship day plays one second. Addresses are canonical hex; every tenth order is an IPv6 conversation.
"""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DAY = "datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01')"
_HEX = "lower(lpad(hex({0}), {1}, '0'))"


def _address(v4: str, v6_head: str, v6_tail: str) -> str:
    return (
        f"CASE WHEN l_orderkey % 10 = 0 THEN '{v6_head}' || {_HEX.format(v6_tail, 24)}"
        f" ELSE {_HEX.format(v4, 8)} END"
    )


_SRC = _address("167772160 + l_orderkey", "20010db8", "l_orderkey")
_DST = _address("3232235520 + l_orderkey % 4096", "20010db9", "l_orderkey % 4096")
_KEY = f"""{_SRC} AS src_ip, {_DST} AS dst_ip,
    CAST(1024 + l_orderkey % 60000 AS INT) AS src_port,
    CAST(CASE WHEN l_orderkey % 3 = 0 THEN 53 ELSE 443 END AS INT) AS dst_port,
    CAST(CASE WHEN l_orderkey % 3 = 0 THEN 17 ELSE 6 END AS INT) AS protocol"""

_REF = f"""SELECT {_KEY},
    CAST(min({_DAY}) * 1000 AS BIGINT) AS start_time, CAST(max({_DAY}) * 1000 AS BIGINT) AS end_time,
    CAST(sum(l_linenumber) AS BIGINT) AS packets, CAST(sum(CAST(l_quantity AS BIGINT) * 40) AS BIGINT) AS bytes
  FROM lineitem GROUP BY l_orderkey"""

# Planted faults: missing (97), unexpected (101), shifted (83), scaled (89).
_PROBE = f"""SELECT {_KEY.replace('167772160 + l_orderkey', '167772160 + l_orderkey + CASE WHEN l_orderkey % 101 = 0 THEN 1048576 ELSE 0 END')},
    CAST({_DAY} * 1000 + CASE WHEN l_orderkey % 83 = 0 THEN 500 ELSE 0 END AS BIGINT) AS start_time,
    CAST({_DAY} * 1000 + CASE WHEN l_orderkey % 83 = 0 THEN 500 ELSE 0 END AS BIGINT) AS end_time,
    CAST(l_linenumber + CASE WHEN l_orderkey % 89 = 0 THEN 1 ELSE 0 END AS BIGINT) AS packets,
    CAST(CAST(l_quantity AS BIGINT) * 40 AS BIGINT) AS bytes
  FROM lineitem WHERE l_orderkey % 97 <> 0"""

_ODD = "l_linenumber % 2 = 1"
_PROFILE = f"""SELECT l_orderkey AS flow_id,
    CAST(min({_DAY}) * 1000 AS BIGINT) AS start_time, CAST(max({_DAY}) * 1000 AS BIGINT) AS end_time,
    CAST(CASE WHEN l_orderkey % 10 = 0 THEN 6 ELSE 4 END AS INT) AS l3_proto,
    CAST(CASE WHEN l_orderkey % 3 = 0 THEN 17 ELSE 6 END AS INT) AS l4_proto,
    CAST(CASE WHEN l_orderkey % 7 = 0 THEN 443 ELSE 20000 + l_orderkey % 40000 END AS INT) AS src_port,
    CAST(CASE WHEN l_orderkey % 7 = 0 THEN 20000 + l_orderkey % 40000 WHEN l_orderkey % 3 = 0 THEN 53 ELSE 443 END AS INT) AS dst_port,
    CAST(sum(CASE WHEN {_ODD} THEN l_linenumber ELSE 0 END) AS BIGINT) AS packets,
    CAST(sum(CASE WHEN {_ODD} THEN CAST(l_quantity AS BIGINT) * 40 ELSE 0 END) AS BIGINT) AS bytes,
    CAST(sum(CASE WHEN {_ODD} THEN 0 ELSE l_linenumber END) AS BIGINT) AS packets_rev,
    CAST(sum(CASE WHEN {_ODD} THEN 0 ELSE CAST(l_quantity AS BIGINT) * 40 END) AS BIGINT) AS bytes_rev,
    {_SRC} AS src_ip, {_DST} AS dst_ip
  FROM lineitem GROUP BY l_orderkey"""

# Report times are fractional ms; an absent direction has zero times.
_REPORT = f"""SELECT {_SRC} AS src_ip, {_DST} AS dst_ip,
    CAST(coalesce(min(CASE WHEN {_ODD} THEN {_DAY} * 1000 + 0.75 END), 0) AS DOUBLE) AS start_time,
    CAST(coalesce(max(CASE WHEN {_ODD} THEN {_DAY} * 1000 + 0.75 END), 0) AS DOUBLE) AS end_time,
    CAST(coalesce(min(CASE WHEN {_ODD} THEN NULL ELSE {_DAY} * 1000 + 0.25 END), 0) AS DOUBLE) AS start_time_rev,
    CAST(coalesce(max(CASE WHEN {_ODD} THEN NULL ELSE {_DAY} * 1000 + 0.25 END), 0) AS DOUBLE) AS end_time_rev,
    CAST(CASE WHEN l_orderkey % 10 = 0 THEN 6 ELSE 4 END AS INT) AS l3_proto,
    CAST(CASE WHEN l_orderkey % 3 = 0 THEN 17 ELSE 6 END AS INT) AS l4_proto,
    CAST(1024 + l_orderkey % 60000 AS INT) AS src_port,
    CAST(CASE WHEN l_orderkey % 3 = 0 THEN 53 ELSE 443 END AS INT) AS dst_port,
    CAST(sum(CASE WHEN {_ODD} THEN l_linenumber ELSE 0 END) AS BIGINT) AS packets,
    CAST(sum(CASE WHEN {_ODD} THEN CAST(l_quantity AS BIGINT) * 40 ELSE 0 END) AS BIGINT) AS bytes,
    CAST(sum(CASE WHEN {_ODD} THEN 0 ELSE l_linenumber END) AS BIGINT) AS packets_rev,
    CAST(sum(CASE WHEN {_ODD} THEN 0 ELSE CAST(l_quantity AS BIGINT) * 40 END) AS BIGINT) AS bytes_rev
  FROM lineitem GROUP BY l_orderkey"""

_PACKETS = f"""SELECT l_orderkey AS flow_id, CAST(l_linenumber AS INT) AS seq,
    CAST({_DAY} AS BIGINT) * 1000000000 + l_linenumber AS ts_ns,
    CASE WHEN {_ODD} THEN 'F' ELSE 'R' END AS dir, CAST(l_quantity AS BIGINT) * 40 AS size,
    CASE WHEN {_ODD} THEN {_SRC} ELSE {_DST} END AS src_ip, CASE WHEN {_ODD} THEN {_DST} ELSE {_SRC} END AS dst_ip,
    CAST(CASE WHEN {_ODD} THEN 1024 + l_orderkey % 60000 WHEN l_orderkey % 3 = 0 THEN 53 ELSE 443 END AS INT) AS src_port,
    CAST(CASE WHEN {_ODD} AND l_orderkey % 3 = 0 THEN 53 WHEN {_ODD} THEN 443 ELSE 1024 + l_orderkey % 60000 END AS INT) AS dst_port,
    CAST(CASE WHEN l_orderkey % 10 = 0 THEN 6 ELSE 4 END AS INT) AS l3_proto,
    CAST(CASE WHEN l_orderkey % 3 = 0 THEN 17 ELSE 6 END AS INT) AS l4_proto,
    CAST(CASE WHEN l_orderkey % 500 = 0 THEN l_linenumber ELSE 0 END AS INT) AS vlan_id, CAST(0 AS INT) AS mpls_label,
    CAST(CASE WHEN l_linenumber >= 6 THEN l_linenumber ELSE 0 END AS BIGINT) AS frag_id,
    CASE WHEN l_linenumber >= 6 AND l_partkey % 2 = 0 THEN 'more' WHEN l_linenumber >= 6 THEN 'last' ELSE 'none' END AS frag_flag
  FROM lineitem"""

# Arrival order is event_id; one minute plays one second.
_RAW_SPARK = "unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000"
_RAW = """SELECT CAST(({us}) AS BIGINT) / 60000000.0E0 AS start_time, value AS duration,
    CAST(CASE WHEN user_id % 5 = 0 THEN 1 WHEN user_id % 2 = 0 THEN 17 ELSE 6 END AS INT) AS proto,
    CASE WHEN event_type IN ('error', 'purchase') THEN '192.168.0.' || (user_id % 4) ELSE '10.0.0.' || (user_id % 20) END AS src_ip,
    CASE WHEN event_type IN ('error', 'purchase') THEN '10.0.0.' || (user_id % 20) ELSE '192.168.0.' || (user_id % 4) END AS dst_ip,
    CAST(CASE WHEN event_type IN ('error', 'purchase') THEN 443 ELSE 40000 END AS INT) AS src_port,
    CAST(CASE WHEN event_type IN ('error', 'purchase') THEN 40000 ELSE 443 END AS INT) AS dst_port,
    CAST(1 + event_id % 4 AS BIGINT) AS packets, CAST((1 + event_id % 4) * 60 AS BIGINT) AS bytes,
    event_id AS arrival_seq
  FROM events"""

_SQL = {
    "ref_flows": _REF, "probe_flows": _PROBE, "profile": _PROFILE, "report": _REPORT, "packets": _PACKETS,
    "raw_flows": _RAW.format(us="epoch_us(ts) - 1704067200000000"),
}
_SPARK = {**_SQL, "raw_flows": _RAW.format(us=_RAW_SPARK)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``ref_flows, probe_flows, profile, report, packets, raw_flows``."""
    source = "events" if name == "raw_flows" else "lineitem"
    # The view text reads one table, which becomes an argument of the statement.
    text = _SPARK[name].replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


def cte(*names: str, **more: str) -> str:
    """``WITH`` clause for the oracle: derived views, then further named queries in the given order."""
    day = "datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"
    parts = [f"{n} AS ({_SQL[n].replace(_DAY, day).replace('hex(', 'to_hex(')})" for n in names]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
