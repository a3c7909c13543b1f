"""Registered queries: whole verdicts, scenario operators, streaming jobs over the test tables."""

import os

from pyspark.sql import functions as F

from biflux.functions.ip import network_bounds
from biflux.functions.scalars import speed_tokens
from biflux.operators import scenario
from biflux.operators.compare import Metric, RunStats
from biflux.operators.profile_build import to_ms
from biflux.plans import compare_queries as cq, profile_queries as pq
from biflux.plans.verdicts import overload_verdict, simulation_verdict
from biflux.plans.views import cte, table, view
from biflux.runtime import shared_folder
from biflux.streaming.cache import close_profile_stream, limited_open_flows, run_limited_stream
from biflux.streaming.closing import drain
from biflux.streaming.meter import open_seconds, stream_timeline

CONFIG = {"units": [{"srcip": "None"}, {"srcip": "addConstant(16777216)"}], "loop": {"srcip": "addOffset(33554432)"}}
# (loop, source offset, destination offset, units)
_COPIES = [(loop, loop * 33554432 + unit, 0, 1) for loop in (0, 1) for unit in (0, 16777216)]
METRICS = [Metric("PACKETS", 0.02), Metric("BYTES", 0.02), Metric("FLOWS", 0.02)]


def _exported(spark, sf_dir, plan=CONFIG, loops=2):
    """What a probe with faults reports for the replicated traffic: flows of some units are lost or doubled."""
    from biflux.operators.replicate import replicate_reference

    copied = replicate_reference(view(spark, sf_dir, "ref_flows"), plan, loops)
    return copied.where("src_port % 97 <> 0").withColumn(
        "packets", F.when(F.col("src_port") % 89 == 0, F.col("packets") + 3).otherwise(F.col("packets")))


def _simulation(spark, sf_dir):
    result, _ = simulation_verdict(view(spark, sf_dir, "ref_flows"), _exported(spark, sf_dir), CONFIG, 2, RunStats(), METRICS)
    return result


def _simulation_precise(spark, sf_dir):
    _, precise = simulation_verdict(
        view(spark, sf_dir, "ref_flows"), _exported(spark, sf_dir), CONFIG, 2, RunStats(), METRICS, precise=True)
    return precise


PREFILTER = ["10.0.0.0/19", "11.0.0.0/20"]


def _simulation_prefilter(spark, sf_dir):
    result, _ = simulation_verdict(
        view(spark, sf_dir, "ref_flows"), _exported(spark, sf_dir), CONFIG, 2, RunStats(), METRICS, prefilter=PREFILTER)
    return result


def _range_sql(net: str) -> str:
    low, high = network_bounds(net)
    inside = " OR ".join(f"(length({c}) = 8 AND {c} BETWEEN '{low}' AND '{high}')" for c in ("src_ip", "dst_ip"))
    return f"({inside})"


def _sim_sql(parts, copies, complement: bool = False) -> str:
    base = cq._replicate_sql(copies, 1.0, "@").rpartition("@")[0]
    more = """, probe AS (SELECT * REPLACE (CASE WHEN src_port % 89 = 0 THEN packets + 3 ELSE packets END AS packets) FROM copies WHERE src_port % 97 <> 0)"""
    rows = []
    for i, (label, where) in enumerate(parts):
        for metric, agg in (("PACKETS", "sum(packets)"), ("BYTES", "sum(bytes)"), ("FLOWS", "count(*)")):
            rows.append(f"""SELECT {i} AS rule_id, '{label}' AS segment, '{metric}' AS metric, CAST(0.02 AS DOUBLE) AS tolerance,
              (SELECT CAST(coalesce({agg}, 0) AS DOUBLE) FROM probe WHERE {where}) AS value, (SELECT CAST(coalesce({agg}, 0) AS DOUBLE) FROM copies WHERE {where}) AS reference""")
    result = base + more + f", tests AS ({' UNION ALL '.join(rows)}) " + """SELECT rule_id, segment, metric, value, reference,
      abs(value - reference) / nullif(reference, 0) AS diff, tolerance,
      CASE WHEN reference = 0 THEN value = 0 ELSE abs(value - reference) / reference <= tolerance END AS passed FROM tests"""
    if complement:
        out = " OR ".join(w for _, w in parts)
        for metric, column in (("PACKETS", "packets"), ("BYTES", "bytes")):
            result += f""" UNION ALL SELECT {len(parts)}, 'COMPLEMENT OF SEGMENTS', '{metric}', v, 0, CASE WHEN v = 0 THEN 0 ELSE 1 END, 0, v = 0
              FROM (SELECT CAST(coalesce(sum({column}), 0) AS DOUBLE) AS v FROM probe WHERE NOT ({out}))"""
    return result


OVERLOAD = {"units": [{"srcip": "None", "dstip": "None"}, {"srcip": "addCounter(0, 5)", "loopOnly": 1}],
            "loop": {"srcip": "addOffset(16777216)", "dstip": "addOffset(16777216)"}}
_OVERLOAD_COPIES = [(loop, loop * 16777216, loop * 16777216, 1) for loop in (0, 2)]


def _overload_segments():
    return [cq.SubnetSegment(f"{10 + loop}.0.0.0/8") for loop in (0, 2)]


def _overload(spark, sf_dir):
    plan = {"units": [{"srcip": "None"}], "loop": OVERLOAD["loop"]}
    return overload_verdict(view(spark, sf_dir, "ref_flows"), _exported(spark, sf_dir, plan, 3), OVERLOAD, _overload_segments(), RunStats(), METRICS)


def _net(net: str) -> str:
    low, high = network_bounds(net)
    return f"(length(src_ip) = 8 AND src_ip BETWEEN '{low}' AND '{high}')"


def _scenarios(spark, sf_dir):
    """Customers play scenarios: optional speeds, requirements, sampling."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS scenario", "CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 10 END AS mbps", "CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 1000 END AS pps",
        "CASE WHEN c_custkey % 11 = 0 THEN CAST(2 AS DOUBLE) END AS speed_multiplier", "CASE WHEN c_custkey % 2 = 0 THEN 400 END AS default_mbps",
        "CASE WHEN c_custkey % 3 = 0 THEN 90000 END AS default_pps", "CAST(NULL AS DOUBLE) AS default_speed_multiplier",
        "CASE WHEN c_custkey % 4 = 0 THEN 6 END AS replicator", "CAST(1 AS DOUBLE) / (1 + c_nationkey) AS sampling",
        "CASE c_nationkey % 4 WHEN 0 THEN array('dns') WHEN 1 THEN array('dns', 'tls') WHEN 2 THEN array('quic') ELSE array() END AS protocols",
        "CAST(c_nationkey * 10 AS DOUBLE) AS required_speed")


def _speeds(spark, sf_dir):
    rows = scenario.replication_units(scenario.replay_speed(_scenarios(spark, sf_dir)))
    return rows.select("scenario", "speed_kind", "speed", "units", speed_tokens(F.col("speed_kind"), F.col("speed")).alias("tokens"))


def _runnable(spark, sf_dir):
    return scenario.runnable(_scenarios(spark, sf_dir), ["dns", "tls"], 150.0).select("scenario")


LISTS = [
    {"name": "base", "items": {"sim": ["t1", {"t2": "old reason"}], "val": ["t3"]}},
    {"name": "probe", "include": "base", "items": {"sim": [{"t2": "drops packets"}, {"t5": "slow"}]}},
]


def _known(spark, sf_dir):
    results = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run", "CASE WHEN o_orderkey % 2 = 0 THEN 'sim' ELSE 'val' END AS grp", "concat('t', o_orderkey % 6) AS test", "o_orderkey % 5 <> 0 AS passed")
    marked = scenario.suppress_known(results, scenario.known_failures(LISTS, "probe"))
    return marked.groupBy("grp", "test", "reason", "verdict").agg(F.count("*").alias("runs"))


def _threshold(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 50 AS probe", "CAST(o_totalprice / 1000 AS INT) * 100 AS speed", "CAST(o_totalprice / 1000 AS INT) * 100 < 5000 + (o_custkey % 50) * 500 AS passed")
    return scenario.throughput_threshold(runs, 1000, 20_000, ["probe"])


def _ranges(spark, sf_dir):
    """Ranges of 256 addresses of both versions."""
    net = F.substring("src_ip", F.lit(1), F.length("src_ip") - 2)
    ranges = view(spark, sf_dir, "ref_flows").select(F.concat(net, F.lit("00")).alias("low"), F.concat(net, F.lit("ff")).alias("high")).distinct()
    return scenario.extended_range_table(ranges, [0, 256], 1024, 3)


def _stream_folder(spark, sf_dir, rows, name):
    """A folder of parquet files for a stream to read, next to the checkpoints."""
    path = f"{shared_folder(spark)}/{name}-{os.urandom(8).hex()}"
    rows.write.parquet(path)
    return path


def _source(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _stream_profile(spark, sf_dir):
    """All biflows of a stream over all events: finished ones, and those still open at its end."""
    path = _stream_folder(spark, sf_dir, to_ms(view(spark, sf_dir, "raw_flows")), "profile")
    return close_profile_stream(_source(spark, path), f"{path}-out", f"{path}-state")[0]


def _stream_limited(spark, sf_dir):
    """Four caches of at most 24 flows over flows whose ports change every half hour. Records last 245 s at most, so what a
    full cache lets go could not have been extended: the result is that of a cache without a limit."""
    later = F.when(F.col("start_time") > 0, F.floor(F.col("start_time") / 1_800_000)).otherwise(0).cast("int")
    rows = to_ms(view(spark, sf_dir, "raw_flows")).withColumns({
        "end_time": F.col("start_time") + F.floor((F.col("end_time") - F.col("start_time")) / 2),
        **{c: F.when(F.col(c) == 40000, F.col(c) + later).otherwise(F.col(c)) for c in ("src_port", "dst_port")}})
    path = _stream_folder(spark, sf_dir, rows, "limited")
    drain(run_limited_stream(_source(spark, path), f"{path}-out", f"{path}-state", limit=24, caches=4))
    still = limited_open_flows(spark, f"{path}-state")
    return spark.read.schema(still.schema).parquet(f"{path}-out").unionByName(still)


def _stream_late(spark, sf_dir):
    """A stream in two parts, every 50th record of the second one 10 000 s late: what was counted, what was dropped."""
    rows = to_ms(view(spark, sf_dir, "raw_flows"))
    half = rows.count() // 2
    late = F.when((F.col("arrival_seq") >= half) & (F.col("arrival_seq") % 50 == 0), 10_000_000).otherwise(0)
    rows = rows.withColumns({c: F.col(c) - late for c in ("start_time", "end_time")})
    path = _stream_folder(spark, sf_dir, rows.where(F.col("arrival_seq") < half), "late")
    _, before = close_profile_stream(_source(spark, path), f"{path}-out", f"{path}-state")
    rows.where(F.col("arrival_seq") >= half).write.mode("append").parquet(path)
    flows, after = close_profile_stream(_source(spark, path), f"{path}-out", f"{path}-state")
    return flows.agg(F.sum(F.col("packets") + F.col("packets_rev")).alias("packets"), F.sum(F.col("bytes") + F.col("bytes_rev")).alias("bytes"),
                     F.lit(before + after).cast("long").alias("late_rows"))


def _stream_timeline(spark, sf_dir):
    """Every second of a stream over all profile rows: those the watermark has passed, and the rest from the state."""
    path = _stream_folder(spark, sf_dir, view(spark, sf_dir, "profile"), "timeline")
    stream = stream_timeline(_source(spark, path))
    drain(stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}-out").option(
        "checkpointLocation", f"{path}-state").trigger(availableNow=True).start())
    seconds = spark.read.schema(stream.schema).parquet(f"{path}-out").unionByName(open_seconds(spark, f"{path}-state"))
    return seconds.select("second", F.round("packets", 6).alias("packets"), F.round("bits", 6).alias("bits"), "starts")


QUERIES = {
    "simulation_verdict": (_simulation, _sim_sql([("ALL", "true")], _COPIES)),
    "simulation_prefilter": (_simulation_prefilter, _sim_sql([(f"{n} <-> *", _range_sql(n)) for n in PREFILTER], _COPIES, True)),
    "simulation_precise": (_simulation_precise, cq._replicate_sql(_COPIES, 1.0, "@").rpartition("@")[0] + """SELECT 'ALL' AS segment,
        count(*) FILTER (src_port % 97 = 0) AS missing, CAST(0 AS BIGINT) AS unexpected, count(*) FILTER (src_port % 97 <> 0 AND src_port % 89 = 0) AS scaled,
        CAST(0 AS BIGINT) AS shifted, count(*) FILTER (src_port % 97 <> 0 AND src_port % 89 <> 0 AND len > 300000) AS split,
        count(*) FILTER (src_port % 97 <> 0 AND src_port % 89 <> 0 AND len <= 300000) AS ok, false AS passed FROM copies"""),
    "overload_verdict": (_overload, _sim_sql([(f"{n} -> *", _net(n)) for n in ("10.0.0.0/8", "12.0.0.0/8")], _OVERLOAD_COPIES)),
    "scenario_defaults": (_speeds, """WITH s AS (SELECT c_custkey AS scenario, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 10 END AS mbps,
        CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 1000 END AS pps, CASE WHEN c_custkey % 11 = 0 THEN 2 END AS mult,
        CASE WHEN c_custkey % 2 = 0 THEN 400 END AS dmbps, CASE WHEN c_custkey % 3 = 0 THEN 90000 END AS dpps FROM customer),
      k AS (SELECT *, CASE WHEN mbps IS NOT NULL THEN 'mbps' WHEN pps IS NOT NULL THEN 'pps' WHEN mult IS NOT NULL THEN 'multiplier'
          WHEN dmbps IS NOT NULL THEN 'mbps' WHEN dpps IS NOT NULL THEN 'pps' ELSE 'multiplier' END AS speed_kind,
          CAST(coalesce(mbps, pps, mult, dmbps, dpps, 1) AS DOUBLE) AS speed FROM s)
      SELECT scenario, speed_kind, speed, CAST(CASE WHEN scenario % 4 = 0 THEN 6 ELSE trunc(1 / (1.0::DOUBLE / (1 + c_nationkey))) END AS INTEGER) AS units,
        CAST(CASE speed_kind WHEN 'mbps' THEN speed * 125000 WHEN 'pps' THEN speed ELSE speed * 1000000000 END AS BIGINT) AS tokens FROM k"""),
    "runnable_scenarios": (_runnable, "SELECT c_custkey AS scenario FROM customer WHERE c_nationkey % 4 <> 2 AND c_nationkey * 10 <= 150"),
    "known_failures": (_known, """WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'sim' ELSE 'val' END AS grp, 't' || (o_orderkey % 6) AS test, o_orderkey % 5 <> 0 AS passed FROM orders),
      w(grp, test, reason) AS (VALUES ('sim', 't1', NULL), ('sim', 't2', 'drops packets'), ('sim', 't5', 'slow'), ('val', 't3', NULL)),
      j AS (SELECT r.*, w.reason, w.test IS NOT NULL AS known FROM r LEFT JOIN w ON r.grp = w.grp AND r.test = w.test)
      SELECT grp, test, reason, CASE WHEN known AND passed THEN 'xpassed' WHEN known THEN 'xfailed' WHEN passed THEN 'passed' ELSE 'failed' END AS verdict,
        count(*) AS runs FROM j GROUP BY ALL"""),
    "throughput_threshold": (_threshold, """WITH r AS (SELECT o_custkey % 50 AS probe, CAST(trunc(o_totalprice / 1000) AS INTEGER) * 100 AS speed FROM orders),
      p AS (SELECT *, speed < 5000 + probe * 500 AS passed FROM r), f AS (SELECT probe, min(speed) FILTER (NOT passed) AS fails_at FROM p GROUP BY probe),
      b AS (SELECT f.probe, any_value(fails_at) AS fails_at, CAST(greatest(coalesce(max(speed) FILTER (passed AND (fails_at IS NULL OR speed < fails_at)), 1000), 1000) AS INTEGER) AS speed
        FROM f JOIN p ON p.probe = f.probe GROUP BY f.probe) SELECT probe, fails_at, speed, speed >= 20000 AS passed FROM b"""),
    "extended_ranges": (_ranges, cte("ref_flows", nets="SELECT DISTINCT substr(src_ip, 1, length(src_ip) - 2) || '00' AS low, substr(src_ip, 1, length(src_ip) - 2) || 'ff' AS high FROM ref_flows") + f"""
        SELECT DISTINCT {cq._add_sql('low', 'o')} AS low, {cq._add_sql('high', 'o')} AS high FROM nets, (VALUES (0), (256), (1024), (1280), (2048), (2304)) v(o)"""),
    "stream_profile": (_stream_profile, pq.profile_sql()),
    "stream_limited": (_stream_limited, pq.profile_sql("""SELECT * REPLACE (st + (en - st) // 2 AS en,
        CASE sp WHEN 40000 THEN 40000 + greatest(st, 0) // 1800000 ELSE sp END AS sp, CASE dp WHEN 40000 THEN 40000 + greatest(st, 0) // 1800000 ELSE dp END AS dp) FROM recs0""")),
    "stream_late_rows": (_stream_late, cte("raw_flows", ms=pq._MS_SQL, base=pq._BASE_SQL, recs=pq._RECORDS_SQL, split="SELECT count(*) // 2 AS half FROM events",
        moved="SELECT *, arrival_seq >= half AS second, en - CASE WHEN arrival_seq >= half AND arrival_seq % 50 = 0 THEN 10000000 ELSE 0 END AS t FROM recs, split",
        mark="SELECT max(t) - 300000 AS w FROM moved WHERE NOT second") + """SELECT CAST(sum(packets) FILTER (NOT (second AND t <= w)) AS BIGINT) AS packets,
        CAST(sum(bytes) FILTER (NOT (second AND t <= w)) AS BIGINT) AS bytes, count(*) FILTER (second AND t <= w) AS late_rows FROM moved, mark"""),
    "stream_timeline": (_stream_timeline, cte("profile", sec="""SELECT start_time // 1000 AS a, end_time // 1000 AS b, packets + packets_rev AS p, bytes + bytes_rev AS y FROM profile""",
        per="""SELECT second, sum(p::DOUBLE / (b - a + 1)) AS packets, sum(y::DOUBLE * 8 / (b - a + 1)) AS bits, count(*) FILTER (second = a) AS starts
          FROM (SELECT *, unnest(generate_series(a, b)) AS second FROM sec) GROUP BY second""") + """
        SELECT second, round(packets, 6) AS packets, round(bits, 6) AS bits, starts FROM per"""),
}
