"""Registered queries over collector records: mapping, normalisation, field validation."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from biflux.operators import mapping as mp, validate as va
from biflux.plans.verdicts import validation_verdict
from biflux.plans.views import cte, table, view
from biflux.runtime import durable
from biflux.sources import readers

FIELDS = {
    "src_ip": {"type": "string", "direction": "always", "reverse": "dst_ip"},
    "src_port": {"type": "int", "direction": "always", "reverse": "dst_port"},
    "protocol": {"type": "int", "direction": "always"},
    "mac": {"type": "string", "direction": "always"},
    "bytes": {"type": "int", "direction": "forward", "reverse": "bytes@rev"},
    "packets": {"type": "int", "direction": "forward", "reverse": "packets@rev"},
    "tcp_flags": {"type": "int", "direction": "forward", "reverse": "tcp_flags@rev"},
    "app": {"type": "string", "direction": "any"},
    "dns_rr": {"type": "list", "direction": "any", "subfields": {
        "name": {"type": "string", "direction": "any"}, "ttl": {"type": "int", "direction": "any"}}},
}
KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
MAPPING = {
    "iana:octetDeltaCount": {"map": "bytes"},
    "iana@reverse:octetDeltaCount@reverse": {"map": "bytes@rev"},
    "iana:packetDeltaCount": {"map": "packets", "converter": "hex_to_int"},
    "iana:tcpControlBits": {"map": "tcp_flags", "converter": "flags_to_hex"},
    "iana:sourceIPv4Address": {"map": "src_ip"},
    "iana:sourceIPv6Address": {"map": "src_ip", "converter": "hex_to_lower"},
    "iana:sourceMacAddress": {"map": "mac", "converter": "hex_to_lower"},
    "iana:protocolIdentifier": {"map": "protocol", "converter": "protocol_identifier_to_number"},
    "iana:applicationName": {"map": "app", "converter": "rstrip_zeroes"},
}
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17}


def _dictionary():
    return mp.FieldDictionary(FIELDS, KEY)


_FLAGS = """CASE event_type WHEN 'error' THEN '...R..' WHEN 'purchase' THEN '.AP.SF' WHEN 'click' THEN '.AP.S.' ELSE '.A....' END"""
_FLAG_VALUES = "CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 27 WHEN 'click' THEN 26 ELSE 16 END"
# Entry of the collector record -> (Spark SQL text, condition for the entry to exist)
_RECORD = {
    "iana:octetDeltaCount": ("CAST((1 + event_id % 4) * 60 AS STRING)", "true"),
    "iana@reverse:octetDeltaCount@reverse": ("CAST(event_id % 5 * 100 AS STRING)", "event_id % 2 = 0"),
    "iana:packetDeltaCount": ("concat('0x', lower(hex(1 + event_id % 40)))", "true"),
    "iana:tcpControlBits": (_FLAGS, "true"),
    "iana:sourceIPv4Address": ("concat('10.0.0.', user_id % 20)", "event_id % 9 <> 0"),
    "iana:sourceIPv6Address": ("concat('2001:DB8::', lower(hex(user_id)))", "event_id % 9 = 0"),
    "iana:sourceMacAddress": ("concat('AA:BB:00:00:00:0', user_id % 10)", "event_id % 3 = 0"),
    "iana:protocolIdentifier": ("CASE WHEN user_id % 2 = 0 THEN 'udp' ELSE 'tcp' END", "true"),
    "iana:applicationName": ("concat('0x', lower(hex(16 * (1 + event_id % 50))))", "event_id % 7 <> 0"),
    "vendor:metric": ("CAST(value AS STRING)", "event_id % 4 = 0"),
    "vendor:label": ("event_type", "true"),
}


def _records(spark, sf_dir):
    """Collector records as maps, one per event."""
    entries = ", ".join(f"CASE WHEN {when} THEN struct('{k}' AS key, {v} AS value) END" for k, (v, when) in _RECORD.items())
    return table(spark, sf_dir, "events").selectExpr("event_id", f"map_from_entries(array_compact(array({entries}))) AS record")


def _mapped(spark, sf_dir):
    known = mp.converters(PROTOCOLS)
    return mp.map_fields(_records(spark, sf_dir), mp.check_mapping(MAPPING, known), known)


def _exploded(column):
    def run(spark, sf_dir):
        rows = _mapped(spark, sf_dir).select("event_id", F.explode_outer(column).alias("field", "value"))
        return rows.where(F.col("field").isNotNull())
    return run


def _hex(x: str) -> str:
    return f"lower(to_hex({x}))"


_FIELDS_SQL = {"fields": f"""
  SELECT event_id, 'bytes' AS field, CAST((1 + event_id % 4) * 60 AS VARCHAR) AS value FROM events
  UNION ALL SELECT event_id, 'bytes@rev', CAST(event_id % 5 * 100 AS VARCHAR) FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT event_id, 'packets', CAST(1 + event_id % 40 AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'tcp_flags', CAST({_FLAG_VALUES} AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'src_ip', CASE WHEN event_id % 9 <> 0 THEN '10.0.0.' || (user_id % 20) ELSE '2001:db8::' || {_hex('user_id')} END FROM events
  UNION ALL SELECT event_id, 'mac', 'aa:bb:00:00:00:0' || (user_id % 10) FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, 'protocol', CASE WHEN user_id % 2 = 0 THEN '17' ELSE '6' END FROM events
  UNION ALL SELECT event_id, 'app', '0x' || rtrim({_hex('16 * (1 + event_id % 50)')}, '0') FROM events WHERE event_id % 7 <> 0"""}


def _unmapped(spark, sf_dir):
    return mp.unmapped_summary(_mapped(spark, sf_dir))


def _flags(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("event_id", f"{_FLAGS} AS flags")
    return events.select("event_id", "flags", mp.flags_to_number(F.col("flags")).alias("bits"))


def _texts(spark, sf_dir):
    """Trailing zero stripping and integer literals on derived text."""
    events = table(spark, sf_dir, "events")
    raw = events.selectExpr("event_id", "concat('0x', hex(event_id * 256)) AS hex_text", "concat('name', event_id % 10, '00', char(0), char(0)) AS nul_text")
    return raw.select("event_id", mp.strip_zeroes(F.col("hex_text")).alias("hex_text"), mp.strip_zeroes(F.col("nul_text")).alias("nul_text"),
                      mp.literal_to_number(F.col("hex_text")).alias("number"))


def _normalized(spark, sf_dir):
    """Raw JSON fields with values of the wrong type and fields nobody knows."""
    events = table(spark, sf_dir, "events")
    raw = events.select("event_id", F.map_from_entries(F.array(*[
        F.struct(F.lit(n).alias("key"), F.expr(v).alias("value")) for n, v in {
            "src_ip": "concat('10.0.0.', user_id)", "src_port": "CASE WHEN event_id % 6 = 0 THEN 'high' ELSE CAST(1000 + event_id AS STRING) END",
            "protocol": "'0017'", "bytes@rev": "CAST(event_id % 3 AS STRING)", "app": "event_type", "props": "props",
            "dns_rr": "CASE WHEN event_id % 2 = 0 THEN concat('[{\"name\": \"n', user_id, '\", \"ttl\": 0', event_id % 9, ', \"junk\": 1}]') ELSE '{\"ttl\": 5}' END",
        }.items()])).alias("fields"))
    # JSON numbers have no leading zero, so write the ttl as text.
    raw = raw.withColumn("fields", F.transform_values("fields", lambda k, v: F.regexp_replace(v, r'"ttl": 0(\d)', r'"ttl": "0$1"')))
    return mp.normalize(raw, _dictionary())


def _normalize(spark, sf_dir):
    wide = _normalized(spark, sf_dir)
    scalars = wide.select("event_id", F.explode_outer("scalars").alias("field", "value"))
    lists = wide.select("event_id", F.explode_outer("lists").alias("list", "items")).select("event_id", F.explode_outer("items").alias("item"))
    skipped = wide.select("event_id", F.explode_outer("skipped").alias("value")).select("event_id", F.lit("skipped").alias("field"), "value")
    rows = scalars.unionByName(lists.select("event_id", F.explode_outer("item").alias("field", "value"))).unionByName(skipped)
    return rows.where(F.col("value").isNotNull() & F.col("field").isNotNull())


def _directions(spark, sf_dir):
    rows = mp.split_directions(_normalized(spark, sf_dir), _dictionary())
    return rows.select("event_id", "side", F.explode_outer("values").alias("field", "value"))


def _flow_map(df, id_name, faults: dict):
    """Profile rows as field maps; ``faults`` replaces or (NULL) removes values."""
    values = {
        "src_ip": "src_ip", "dst_ip": "dst_ip", "src_port": "CAST(src_port AS STRING)", "dst_port": "CAST(dst_port AS STRING)",
        "protocol": "CAST(l4_proto AS STRING)", "bytes": "CAST(bytes AS STRING)", "bytes@rev": "CAST(bytes_rev AS STRING)",
        "packets": "CAST(packets AS STRING)", "packets@rev": "CAST(packets_rev AS STRING)", "app": "concat('app', flow_id % 5)",
        **faults,
    }
    entries = F.array_compact(F.array(*[
        F.when(F.expr(v).isNotNull(), F.struct(F.lit(n).alias("key"), F.expr(v).alias("value"))) for n, v in values.items()]))
    return df.select(F.col("flow_id").alias(id_name), F.map_from_entries(entries).alias("fields"))


def _records_of(df, id_name, faults):
    normalized = mp.normalize(_flow_map(df, id_name, faults), _dictionary())
    return mp.with_keys(mp.direction_records(normalized, _dictionary()), _dictionary())[0]


CHECKS_SUPPORTED = ["bytes", "packets", "app", "tcp_flags", "dns_rr", "dns_rr.name", "dns_rr.ttl"]


def _checks():
    return va.Checks(_dictionary(), CHECKS_SUPPORTED, {"app": "StartsWith"})


def _validated(spark, sf_dir):
    """Received flows with planted faults against annotations, one annotation per key."""
    profile = view(spark, sf_dir, "profile")
    flows = _records_of(profile.where("flow_id % 97 <> 0"), "unit_id", {
        "packets": "CASE WHEN flow_id % 83 = 0 THEN NULL ELSE CAST(packets AS STRING) END", "mac": "'aa:bb:cc:dd:ee:ff'", "app": "'app'"})
    refs = _records_of(profile.where("flow_id % 101 <> 0"), "ref_id", {
        "bytes": "CASE WHEN flow_id % 89 = 0 THEN CAST(bytes + 1 AS STRING) WHEN flow_id % 4 = 0 THEN concat('[\"', bytes, '\", \"1\"]') ELSE CAST(bytes AS STRING) END"})
    return va.validate(flows, refs, _checks())


_SIDES = """SELECT flow_id, 0 AS side, bytes_rev > 0 OR packets_rev > 0 AS bi FROM profile
  UNION ALL SELECT flow_id, 1, true FROM profile WHERE bytes_rev > 0 OR packets_rev > 0"""
_JUDGED_SQL = {
    "sides": _SIDES,
    "pairs": "SELECT * FROM sides WHERE flow_id % 97 <> 0 AND flow_id % 101 <> 0",
    "fields": """SELECT flow_id, side, 'bytes' AS field, CASE WHEN side = 0 AND flow_id % 89 = 0 THEN 'error' ELSE 'ok' END AS outcome FROM pairs
      UNION ALL SELECT flow_id, side, 'packets', CASE WHEN side = 0 AND flow_id % 83 = 0 THEN 'missing' ELSE 'ok' END FROM pairs
      UNION ALL SELECT flow_id, side, 'app', 'ok' FROM pairs UNION ALL SELECT flow_id, side, 'mac', 'unchecked' FROM pairs""",
}


def _field_compare(spark, sf_dir):
    rows = _validated(spark, sf_dir).where(F.col("fields").isNotNull())
    return rows.select(F.col("unit_id").alias("flow_id"), F.inline_outer("fields")).groupBy("flow_id", "field", "outcome").agg(F.count("*").alias("records"))


def _rivals(spark, sf_dir):
    """Flows that share keys by fours, every fourth reported from the other end, and annotations with other byte counts."""
    here, there = F.lower(F.lpad(F.hex(F.floor(F.col("flow_id") / 4)), 8, "0")), F.lit("c0a80001")
    back = F.col("flow_id") % 4 == 0
    profile = view(spark, sf_dir, "profile").withColumns({
        "src_ip": F.when(back, there).otherwise(here), "dst_ip": F.when(back, here).otherwise(there),
        "src_port": F.when(back, 443).otherwise(4000), "dst_port": F.when(back, 4000).otherwise(443), "l4_proto": F.lit(6)})
    flows = _records_of(profile, "unit_id", {})
    return flows, _records_of(profile, "ref_id", {"bytes": "CAST(bytes + flow_id % 2 AS STRING)"})


def _best_match(spark, sf_dir):
    """Errors of the least-error pairing per key, with what stays without a partner."""
    flows, refs = (durable(x) for x in _rivals(spark, sf_dir))
    results = va.validate(flows, refs, va.Checks(_dictionary(), ["bytes", "packets", "app"]))
    faults = F.size(F.filter("fields", lambda o: o["outcome"].isin("error", "missing")))
    keyed = results.withColumn("k", F.floor(F.coalesce("ref_id", "unit_id") / 4))
    return keyed.groupBy("k").agg(
        F.coalesce(F.sum(faults), F.lit(0)).alias("errors"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("missing", "unexpected")])


# All placements per key: a step places one annotation, and equal sets of used records keep the least cost.
_BEST_SQL = {
    "rec": """SELECT flow_id, flow_id // 4 AS k, CAST(flow_id % 4 = 0 AS INTEGER) AS dir, bytes_rev > 0 OR packets_rev > 0 AS two, flow_id % 5 AS app,
      row_number() OVER (PARTITION BY flow_id // 4 ORDER BY flow_id) AS i, 1 << CAST(row_number() OVER (PARTITION BY flow_id // 4 ORDER BY flow_id) - 1 AS INTEGER) AS bit,
      bytes, packets, bytes_rev, packets_rev FROM profile""",
    "sides": """SELECT flow_id, k, i, bit, two, dir, app, d, CASE WHEN d = dir THEN bytes ELSE bytes_rev END AS b, CASE WHEN d = dir THEN packets ELSE packets_rev END AS p,
      CASE WHEN d = dir THEN bytes + flow_id % 2 ELSE bytes_rev END AS rb FROM rec, (VALUES (0), (1)) AS x(d) WHERE d = dir OR two""",
    "fit": """SELECT r.k, r.i, r.two AS rtwo, r.d, u.two AS utwo, u.bit,
      CAST(r.rb <> u.b AS INTEGER) + CAST(r.p <> u.p AS INTEGER) + CAST(r.app <> u.app AS INTEGER) AS c
      FROM sides r JOIN sides u ON r.k = u.k AND r.d = u.d""",
    "one": """SELECT k, i, d, bit AS m, c FROM fit WHERE rtwo AND NOT utwo UNION ALL SELECT k, i, d, 0, 0 FROM sides WHERE two""",
    "choice": """SELECT k, i, bit AS m0, bit AS m1, sum(c) AS c FROM fit WHERE rtwo AND utwo GROUP BY ALL
      UNION ALL SELECT a.k, a.i, a.m, b.m, a.c + b.c FROM one a JOIN one b ON a.k = b.k AND a.i = b.i AND a.d = 0 AND b.d = 1
      UNION ALL SELECT k, i, CASE d WHEN 0 THEN bit ELSE 0 END, CASE d WHEN 1 THEN bit ELSE 0 END, c FROM fit WHERE NOT rtwo
      UNION ALL SELECT k, i, 0, 0, 0 FROM sides WHERE NOT two""",
    "steps": """SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, 0 AS m0, 0 AS m1, CAST(0 AS HUGEINT) AS c FROM rec
      UNION ALL SELECT s.k, o.i, s.m0 | o.m0, s.m1 | o.m1, min(s.c + o.c) FROM steps s JOIN choice o ON o.k = s.k AND o.i = s.i + 1
      WHERE s.m0 & o.m0 = 0 AND s.m1 & o.m1 = 0 GROUP BY s.k, o.i, s.m0 | o.m0, s.m1 | o.m1""",
    "need": """SELECT k, max(i) AS n, CAST(sum(CASE WHEN two THEN bit ELSE 0 END) AS INTEGER) AS both, count(*) FILTER (two OR dir = 0) AS s0,
      count(*) FILTER (two OR dir = 1) AS s1 FROM rec GROUP BY k""",
}


def _hot_match(spark, sf_dir):
    """A third of all flows under one key, the others by hundreds: one-way records of which only the bytes are compared."""
    k = F.when(F.col("flow_id") % 3 == 0, -1).otherwise(F.floor(F.col("flow_id") / 100))
    profile = view(spark, sf_dir, "profile").withColumns({
        "src_ip": F.lower(F.lpad(F.hex(k + 1), 8, "0")), "dst_ip": F.lit("c0a80001"), "src_port": F.lit(4000), "dst_port": F.lit(443), "l4_proto": F.lit(6),
        "bytes": F.col("bytes") + F.col("bytes_rev"), "bytes_rev": F.lit(0), "packets_rev": F.lit(0), "k": k})
    flows = durable(_records_of(profile, "unit_id", {}))
    refs = durable(_records_of(profile, "ref_id", {"bytes": "CAST(CASE WHEN flow_id % 8 = 0 THEN bytes * 1000 + 1 ELSE bytes + flow_id % 2 END AS STRING)"}))
    results = va.validate(flows, refs, va.Checks(_dictionary(), ["bytes"]))
    ids = profile.select(F.col("flow_id").alias("ref_id"), "k")
    return results.where(F.col("ref_id").isNotNull()).join(ids, "ref_id").groupBy("k").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "error", "missing")])


# List fields: two expected items per flow; received ones come in another order, one with a wrong time to live, one missing or one more.
_ITEM_A = """concat('{"name": "a', flow_id % 3, '", "ttl": ', flow_id % 5 + MORE, '}')"""
_ITEM_B = """'{"name": "b", "ttl": 9}'"""
_SEEN_LIST = f"""concat('[', {_ITEM_B}, CASE WHEN flow_id % 13 <> 0 THEN concat(', ', {_ITEM_A.replace('MORE', 'CASE WHEN flow_id % 7 = 0 THEN 20 ELSE 0 END')}) ELSE '' END,
  CASE WHEN flow_id % 11 = 0 THEN ', {{"name": "c", "ttl": 1}}' ELSE '' END, ']')"""
_WANTED_LIST = f"concat('[', {_ITEM_A.replace('MORE', '0')}, ', ', {_ITEM_B}, ']')"


def _lists(strategy):
    def run(spark, sf_dir):
        profile = view(spark, sf_dir, "profile")
        flows = _records_of(profile, "unit_id", {"dns_rr": _SEEN_LIST})
        refs = _records_of(profile, "ref_id", {"dns_rr": _WANTED_LIST})
        results = va.validate(flows, refs, va.Checks(_dictionary(), ["dns_rr", "dns_rr.name", "dns_rr.ttl"], {"dns_rr": strategy}))
        return results.select(F.col("ref_id").alias("flow_id"), F.inline("fields")).where(F.col("field").startswith("dns_rr")).groupBy(
            "flow_id", "field", "outcome").agg(F.count("*").alias("records"))
    return run


def _lists_sql(rows: str) -> str:
    """Outcomes per direction of a flow: those of both its records, since lists may come from either side."""
    return cte("profile", sides=_SIDES, seen=rows) + "SELECT flow_id, field, outcome, count(*) AS records FROM sides JOIN seen USING (flow_id) GROUP BY ALL"


# With the first item missing and one too many, the extra item (named c, with a time to live of 1) takes its place.
_FULL_LISTS = """SELECT flow_id, 'dns_rr.name' AS field, CASE WHEN flow_id % 143 = 0 THEN 'error' WHEN flow_id % 13 = 0 THEN 'missing' ELSE 'ok' END AS outcome FROM profile
  UNION ALL SELECT flow_id, 'dns_rr.ttl', CASE WHEN flow_id % 143 = 0 THEN CASE flow_id % 5 WHEN 1 THEN 'ok' ELSE 'error' END
    WHEN flow_id % 13 = 0 THEN 'missing' WHEN flow_id % 7 = 0 THEN 'error' ELSE 'ok' END FROM profile
  UNION ALL SELECT flow_id, unnest(['dns_rr.name', 'dns_rr.ttl']), 'ok' FROM profile
  UNION ALL SELECT flow_id, 'dns_rr', 'unexpected' FROM profile WHERE flow_id % 11 = 0 AND flow_id % 13 <> 0"""
_ONE_LISTS = "SELECT flow_id, unnest(['dns_rr.name', 'dns_rr.ttl']) AS field, 'ok' AS outcome FROM profile"


def _override(spark, sf_dir):
    """Annotations with sections of their own per direction: other bytes forward, another application backward."""
    profile = view(spark, sf_dir, "profile")
    flows = _records_of(profile, "unit_id", {})
    annotations = _flow_map(profile, "ref_id", {"bytes": "'1'"}).join(
        profile.select(F.col("flow_id").alias("ref_id"), F.create_map(F.lit("bytes"), F.col("bytes").cast("string")).alias("forward"),
                       F.create_map(F.lit("app"), F.when(F.col("flow_id") % 3 == 0, "other").otherwise(F.concat(F.lit("app"), F.col("flow_id") % 5))).alias("reverse")), "ref_id")
    dictionary = _dictionary()
    refs = mp.with_keys(mp.direction_records(mp.normalize_annotations(annotations, dictionary), dictionary), dictionary)[0]
    results = va.validate(flows, refs, va.Checks(dictionary, ["bytes", "packets", "app"]))
    return results.select(F.col("ref_id").alias("flow_id"), F.inline("fields")).where("outcome IN ('ok', 'error', 'missing')").groupBy(
        "flow_id", "field", "outcome").agg(F.count("*").alias("records"))


def _custom_key(spark, sf_dir):
    """Matched by hosts alone, so the ports are compared; records without a host address have no key."""
    dictionary, key = _dictionary(), ["src_ip", "dst_ip"]
    profile = view(spark, sf_dir, "profile")

    def keyed(name, faults):
        normalized = mp.normalize(_flow_map(profile, name, faults), dictionary)
        return mp.with_keys(mp.direction_records(normalized, dictionary), dictionary, key)

    flows, keyless = keyed("unit_id", {"src_ip": "CASE WHEN flow_id % 10 <> 3 THEN src_ip END", "src_port": "CAST(src_port + CASE WHEN flow_id % 6 = 0 THEN 1 ELSE 0 END AS STRING)"})
    refs, _ = keyed("ref_id", {})
    results = va.validate(flows, refs, va.Checks(dictionary, ["src_port", "dst_port", "bytes"], key=key))
    lost = keyless.select(F.lit("no key").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("flows"))
    return va.flow_statistics(results).unionByName(lost)


def _verdict(spark, sf_dir):
    """From collector records to the verdict: mapped, normalised, matched and counted per outcome, with the keys nobody mapped."""
    known = mp.converters(PROTOCOLS)
    profile = view(spark, sf_dir, "profile")
    cells = {"flow:src": "src_ip", "flow:dst": "dst_ip", "flow:sport": "CAST(src_port AS STRING)", "flow:dport": "CAST(dst_port AS STRING)",
             "flow:proto": "CASE l4_proto WHEN 17 THEN 'udp' ELSE 'tcp' END", "flow:bytes": "CAST(bytes AS STRING)", "flow:bytes@rev": "CAST(bytes_rev AS STRING)",
             "flow:packets": "CASE WHEN flow_id % 9 <> 0 THEN concat('0x', lower(hex(packets))) END", "flow:app": "concat('app', flow_id % 4)", "flow:junk": "CASE WHEN flow_id % 5 = 0 THEN 'x' END"}
    entries = F.array_compact(F.array(*[F.when(F.expr(v).isNotNull(), F.struct(F.lit(k).alias("key"), F.expr(v).alias("value"))) for k, v in cells.items()]))
    records = profile.where("flow_id % 8 <> 1").select(F.col("flow_id").alias("unit_id"), F.map_from_entries(entries).alias("record"))
    mapping = mp.check_mapping({
        "flow:src": {"map": "src_ip"}, "flow:dst": {"map": "dst_ip"}, "flow:sport": {"map": "src_port"}, "flow:dport": {"map": "dst_port"},
        "flow:proto": {"map": "protocol", "converter": "protocol_identifier_to_number"}, "flow:bytes": {"map": "bytes"}, "flow:bytes@rev": {"map": "bytes@rev"},
        "flow:packets": {"map": "packets", "converter": "hex_to_int"}, "flow:app": {"map": "app"}}, known)
    annotations = _flow_map(profile.where("flow_id % 8 <> 2"), "ref_id", {"packets@rev": "CAST(NULL AS STRING)", "app": "concat('app', flow_id % 4)"})
    results, unmapped = validation_verdict(records, annotations, mapping, va.Checks(_dictionary(), ["bytes", "packets", "app"]), known)
    keys = unmapped.select(F.concat(F.lit("unmapped "), "key").alias("outcome"), F.col("records").alias("flows"))
    return va.flow_statistics(results).unionByName(keys)


def _coverage(spark, sf_dir):
    """Per set of fields, whether any of them was really compared."""
    # Records with the same outcomes tell the same: one of each is kept, without the values.
    results = durable(_validated(spark, sf_dir).select(F.transform("fields", lambda o: F.struct(o["field"].alias("field"), o["outcome"].alias("outcome"))).alias("fields")).distinct())
    sets = {"any": ["tcp_flags", "app"], "flags": ["tcp_flags"], "mac": ["mac"], "bytes": ["bytes"], "lists": ["dns_rr", "dns_rr.name"]}
    return reduce(DataFrame.unionByName, [va.coverage(results, f).select(F.lit(n).alias("fields"), "covered") for n, f in sets.items()])


def _validation_summary(spark, sf_dir):
    """Verdict per test, where the address version plays the test."""
    profile = view(spark, sf_dir, "profile").select(F.col("flow_id").alias("ref_id"), F.concat(F.lit("ipv"), "l3_proto").alias("test"))
    units = profile.withColumnRenamed("ref_id", "unit_id")
    results = _validated(spark, sf_dir)
    tested = results.where(F.col("ref_id").isNotNull()).join(profile, "ref_id").select("test", "outcome").unionByName(
        results.where(F.col("ref_id").isNull()).join(units, "unit_id").select("test", "outcome"))
    keys = _mapped(spark, sf_dir).select(F.concat(F.lit("ipv"), F.when(F.col("event_id") % 9 == 0, 6).otherwise(4)).alias("test"), F.explode_outer("unmapped").alias("key")).where(F.col("key").isNotNull())
    skipped = _normalized(spark, sf_dir).select(F.lit("ipv4").alias("test"), F.explode_outer("skipped").alias("field")).where(F.col("field").isNotNull())
    summary = va.test_summary(tested, keys, skipped)
    return summary.select("test", "passed", F.concat_ws(",", "unmapped").alias("unmapped"), F.concat_ws(",", "unknown").alias("unknown"))


def _json_lines(spark, sf_dir):
    """A dumped JSON array of records made from events, with null ports, null addresses and broken lines."""
    return table(spark, sf_dir, "events").selectExpr("event_id", """
      CASE WHEN event_id % 50 = 0 THEN '[' WHEN event_id % 50 = 1 THEN '{"flowstart": 1, ' ELSE concat(
        '{"flowstart": ', event_id * 10, ', "flowend": "', event_id * 10 + 5, '", "proto": 6, "srcip": ',
        CASE WHEN event_id % 50 = 2 THEN 'null' ELSE concat('"10.0.0.', user_id, '"') END, ', "dstip": "10.1.0.1", "srcport": ',
        CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(1000 + user_id AS STRING) END, ', "dstport": 53, "pkts": 2, "bytes": ', 100 + user_id, '},') END AS value""")


def _flow_json(spark, sf_dir):
    return readers.parse_flow_json(_json_lines(spark, sf_dir)).rows


def _flow_json_rejected(spark, sf_dir):
    return readers.parse_flow_json(_json_lines(spark, sf_dir)).rejected.select("event_id")


def _text_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", """concat_ws(', ', event_id * 10, CAST(user_id AS DOUBLE) / 8,
      CASE WHEN event_id % 10 = 0 THEN 'ARP' WHEN event_id % 10 = 1 THEN '' ELSE '17' END, concat('10.0.0.', user_id), '10.1.0.1', user_id, 53, 2, 120,
      CASE WHEN event_id % 2 = 0 THEN '192.0.2.1' ELSE '192.0.2.2' END, event_id % 3) AS value""")


def _flow_text(spark, sf_dir):
    return readers.parse_flow_text(_text_lines(spark, sf_dir), "192.0.2.2", 1).rows


def _profile_lines(spark, sf_dir):
    """Profile CSV lines with planted faults."""
    return view(spark, sf_dir, "profile").selectExpr("flow_id", """concat_ws(',', CASE flow_id % 40 WHEN 1 THEN 'x' ELSE concat(' ', start_time) END, end_time,
      CASE flow_id % 40 WHEN 2 THEN 5 ELSE l3_proto END, CASE flow_id % 40 WHEN 3 THEN 47 WHEN 4 THEN 1 ELSE l4_proto END,
      CASE flow_id % 40 WHEN 5 THEN '' WHEN 6 THEN '65536' ELSE CAST(src_port AS STRING) END, dst_port, packets,
      CASE flow_id % 40 WHEN 7 THEN '-1' ELSE CAST(bytes AS STRING) END, packets_rev, bytes_rev,
      CASE flow_id % 40 WHEN 8 THEN '' WHEN 9 THEN '1.2.3' WHEN 10 THEN concat('1.2.3.4', ',', '5') ELSE CASE l3_proto WHEN 4 THEN '10.0.0.1' ELSE '2001:db8::1' END END) AS value""")


_HEADER = ["START_TIME", "END_TIME", "L3_PROTO", "L4_PROTO", "SRC_PORT", "DST_PORT", "PACKETS", "BYTES", "PACKETS_REV", "BYTES_REV", "SRC_IP"]
_ERROR = """CASE flow_id % 40 WHEN 1 THEN 'start_time: no number in range' WHEN 2 THEN 'l3_proto: not supported' WHEN 3 THEN 'l4_proto: not supported'
  WHEN 6 THEN 'src_port: no number in range' WHEN 7 THEN 'bytes: no number in range' WHEN 9 THEN 'src_ip: no address of this version' WHEN 10 THEN 'line: cells do not match the header' END"""


def _profile_read(spark, sf_dir):
    return readers.parse_profile(_profile_lines(spark, sf_dir), _HEADER, skip_unknown=True).rows


def _profile_rejected(spark, sf_dir):
    rejected = readers.parse_profile(_profile_lines(spark, sf_dir), _HEADER, skip_unknown=True).rejected
    return rejected.select("flow_id", "error", "skipped")


def _profile_summary(spark, sf_dir):
    return readers.parse_summary(readers.parse_profile(_profile_lines(spark, sf_dir), _HEADER, skip_unknown=True))


def _profile_strict(spark, sf_dir):
    profile = view(spark, sf_dir, "profile").withColumns({
        c: F.when(F.col("flow_id") % 20 == r, 0).otherwise(F.col(c)).cast("long")
        for r, cs in ((1, ("packets", "packets_rev")), (2, ("bytes", "bytes_rev"))) for c in cs})
    return readers.strict_profile(profile).rejected.select("flow_id", "error")


def _run_logs(spark, sf_dir):
    """Log lines of one replay per user."""
    lines = table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS file", "event_id AS line_no", """
      CASE event_type WHEN 'click' THEN concat('Actual: ', event_id, ' packets (', event_id * 64, ' bytes) sent in 1.5 seconds')
        WHEN 'view' THEN concat('Start time: 2024-01-01 00:00:00 [ms since epoch: ', event_id, ']')
        WHEN 'error' THEN concat('End time: 2024-01-01 00:00:00 [ms since epoch: ', event_id + 7, ']') ELSE 'warming up' END AS value""")
    return readers.run_log_totals(lines)


QUERIES = {
    "map_fields": (_exploded("fields"), cte(**_FIELDS_SQL) + "SELECT * FROM fields"),
    "unmapped_fields": (_unmapped, "SELECT 'vendor:label' AS key, count(*) AS records FROM events UNION ALL SELECT 'vendor:metric', count(*) FROM events WHERE event_id % 4 = 0"),
    "convert_flags": (_flags, f"SELECT event_id, {_FLAGS} AS flags, CAST({_FLAG_VALUES} AS BIGINT) AS bits FROM events"),
    "convert_texts": (_texts, """SELECT event_id, '0x' || rtrim(to_hex(event_id * 256), '0') AS hex_text, 'name' || (event_id % 10) || '00' AS nul_text,
        event_id * 256 AS number FROM events"""),
    "normalize_types": (_normalize, """SELECT event_id, 'src_ip' AS field, '10.0.0.' || user_id AS value FROM events
        UNION ALL SELECT event_id, 'src_port', CAST(1000 + event_id AS VARCHAR) FROM events WHERE event_id % 6 <> 0
        UNION ALL SELECT event_id, 'skipped', 'src_port' FROM events WHERE event_id % 6 = 0 UNION ALL SELECT event_id, 'protocol', '17' FROM events
        UNION ALL SELECT event_id, 'bytes@rev', CAST(event_id % 3 AS VARCHAR) FROM events UNION ALL SELECT event_id, 'app', event_type FROM events
        UNION ALL SELECT event_id, 'skipped', 'props' FROM events UNION ALL SELECT event_id, 'dns_rr.name', 'n' || user_id FROM events WHERE event_id % 2 = 0
        UNION ALL SELECT event_id, 'dns_rr.ttl', CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 9 AS VARCHAR) ELSE '5' END FROM events"""),
    "split_directions": (_directions, cte(both_sides="SELECT *, 'fwd' AS side FROM events UNION ALL SELECT *, 'rev' FROM events WHERE event_id % 3 <> 0") + """
        SELECT event_id, side, CASE side WHEN 'fwd' THEN 'src_ip' ELSE 'dst_ip' END AS field, '10.0.0.' || user_id AS value FROM both_sides
        UNION ALL SELECT event_id, side, CASE side WHEN 'fwd' THEN 'src_port' ELSE 'dst_port' END, CAST(1000 + event_id AS VARCHAR) FROM both_sides WHERE event_id % 6 <> 0
        UNION ALL SELECT event_id, side, 'protocol', '17' FROM both_sides UNION ALL SELECT event_id, side, 'app', event_type FROM both_sides
        UNION ALL SELECT event_id, side, 'bytes', CAST(event_id % 3 AS VARCHAR) FROM both_sides WHERE side = 'rev'"""),
    "field_compare": (_field_compare, cte("profile", **_JUDGED_SQL) + "SELECT flow_id, field, outcome, count(*) AS records FROM fields GROUP BY ALL"),
    "field_stats": (lambda s, d: va.field_statistics(_validated(s, d)), cte("profile", **_JUDGED_SQL) + """
        SELECT coalesce(field, 'TOTAL') AS field, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'error') AS error,
          count(*) FILTER (outcome = 'missing') AS missing, CAST(0 AS BIGINT) AS unexpected, count(*) FILTER (outcome = 'unchecked') AS unchecked
        FROM fields GROUP BY ROLLUP (field)"""),
    "flow_stats": (lambda s, d: va.flow_statistics(_validated(s, d)), cte("profile", **_JUDGED_SQL) + """
        SELECT CASE WHEN flow_id % 97 = 0 THEN 'missing' WHEN flow_id % 101 = 0 THEN 'unexpected'
          WHEN side = 0 AND (flow_id % 89 = 0 OR flow_id % 83 = 0) THEN 'error' ELSE 'ok' END AS outcome, count(*) AS flows
        FROM sides WHERE NOT (flow_id % 97 = 0 AND flow_id % 101 = 0) GROUP BY 1"""),
    "field_coverage": (_coverage, cte("profile", **_JUDGED_SQL, wanted="SELECT * FROM (VALUES ('any', 'tcp_flags'), ('any', 'app'), ('flags', 'tcp_flags'), ('mac', 'mac'), ('bytes', 'bytes'), ('lists', 'dns_rr')) v(fields, field)") + """
        SELECT fields, bool_or(coalesce(outcome IN ('ok', 'error'), false)) AS covered FROM wanted LEFT JOIN fields USING (field) GROUP BY fields""".replace("LEFT JOIN fields", "LEFT JOIN fields judged").replace("GROUP BY fields", "GROUP BY wanted.fields").replace("SELECT fields", "SELECT wanted.fields AS fields")),
    "field_compare_lists": (_lists("FullArray"), _lists_sql(_FULL_LISTS)),
    "field_compare_one_in_list": (_lists("OneInArray"), _lists_sql(_ONE_LISTS)),
    "field_compare_overrides": (_override, cte("profile", sides=_SIDES, fields="""
        SELECT flow_id, side, 'bytes' AS field, 'ok' AS outcome FROM sides UNION ALL SELECT flow_id, side, 'packets', 'ok' FROM sides
        UNION ALL SELECT flow_id, side, 'app', CASE WHEN side = 1 AND flow_id % 3 = 0 THEN 'error' ELSE 'ok' END FROM sides""") + "SELECT flow_id, field, outcome, count(*) AS records FROM fields GROUP BY ALL"),
    "match_by_custom_key": (_custom_key, cte("profile", sides=_SIDES) + """
        SELECT CASE WHEN flow_id % 10 = 3 THEN 'missing' WHEN flow_id % 6 = 0 THEN 'error' ELSE 'ok' END AS outcome, count(*) AS flows FROM sides GROUP BY 1
        UNION ALL SELECT 'no key', count(*) FROM profile WHERE flow_id % 10 = 3"""),
    "validation_verdict": (_verdict, cte("profile", sides="SELECT flow_id, 0 AS side FROM profile UNION ALL SELECT flow_id, 1 FROM profile WHERE bytes_rev > 0") + """
        SELECT CASE WHEN flow_id % 8 = 1 THEN 'missing' WHEN flow_id % 8 = 2 THEN 'unexpected' WHEN side = 0 AND flow_id % 9 = 0 THEN 'error' ELSE 'ok' END AS outcome,
          count(*) AS flows FROM sides GROUP BY 1
        UNION ALL SELECT 'unmapped flow:junk', count(*) FROM profile WHERE flow_id % 8 <> 1 AND flow_id % 5 = 0"""),
    "validation_summary": (_validation_summary, """SELECT 'ipv4' AS test, false AS passed, 'vendor:label,vendor:metric' AS unmapped, 'props,src_port' AS unknown
        UNION ALL SELECT 'ipv6', false, 'vendor:label,vendor:metric', ''"""),
    "best_match": (_best_match, cte("profile", **_BEST_SQL).replace("WITH", "WITH RECURSIVE", 1) + """
        SELECT s.k, CAST(min(c) AS BIGINT) AS errors, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected FROM steps s JOIN need n ON n.k = s.k AND s.i = n.n
        WHERE bit_count(m0) = s0 AND bit_count(m1) = s1 AND m0 & n.both = m1 & n.both GROUP BY s.k"""),
    "hot_match": (_hot_match, cte(
        "profile", f="SELECT flow_id, CASE WHEN flow_id % 3 = 0 THEN -1 ELSE flow_id // 100 END AS k, bytes + bytes_rev AS u FROM profile",
        g="SELECT *, CASE WHEN flow_id % 8 = 0 THEN u * 1000 + 1 ELSE u + flow_id % 2 END AS r FROM f",
        hits="""SELECT a.k, sum(least(a.n, b.n)) AS ok FROM (SELECT k, u AS v, count(*) AS n FROM g GROUP BY ALL) a
          JOIN (SELECT k, r AS v, count(*) AS n FROM g GROUP BY ALL) b ON a.k = b.k AND a.v = b.v GROUP BY a.k""") + """
        SELECT g.k, CAST(coalesce(any_value(ok), 0) AS BIGINT) AS ok, count(*) - CAST(coalesce(any_value(ok), 0) AS BIGINT) AS error, CAST(0 AS BIGINT) AS missing
        FROM g LEFT JOIN hits ON hits.k = g.k GROUP BY g.k"""),
    "read_flow_json": (_flow_json, """SELECT event_id, event_id * 10 AS start_time, event_id * 10 + 5 AS end_time, 6 AS proto, '10.0.0.' || user_id AS src_ip,
        '10.1.0.1' AS dst_ip, CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1000 + user_id END AS INTEGER) AS src_port, 53 AS dst_port, CAST(2 AS BIGINT) AS packets,
        100 + user_id AS bytes FROM events WHERE event_id % 50 > 2"""),
    "read_flow_json_rejected": (_flow_json_rejected, "SELECT event_id FROM events WHERE event_id % 50 IN (1, 2)"),
    "read_flow_text": (_flow_text, """SELECT event_id, event_id * 10 AS start_time, event_id * 10 + user_id * 125 AS end_time, 17 AS proto, '10.0.0.' || user_id AS src_ip,
        '10.1.0.1' AS dst_ip, CAST(user_id AS INTEGER) AS src_port, 53 AS dst_port, CAST(2 AS BIGINT) AS packets, CAST(120 AS BIGINT) AS bytes
        FROM events WHERE event_id % 10 NOT IN (0, 1) AND event_id % 2 = 1 AND event_id % 3 = 1"""),
    "profile_read": (_profile_read, cte("profile") + f"""SELECT flow_id, start_time, end_time, l3_proto, CASE flow_id % 40 WHEN 4 THEN 1 ELSE l4_proto END AS l4_proto,
        CASE WHEN flow_id % 40 IN (4, 5) THEN 0 ELSE src_port END AS src_port, CASE WHEN flow_id % 40 = 4 THEN 0 ELSE dst_port END AS dst_port,
        packets, bytes, packets_rev, bytes_rev, CASE WHEN flow_id % 40 = 8 THEN NULL WHEN l3_proto = 4 THEN '0a000001' ELSE '20010db8000000000000000000000001' END AS src_ip
        FROM profile WHERE flow_id % 40 NOT IN (1, 2, 3, 6, 7, 9, 10)"""),
    "profile_rejected": (_profile_rejected, cte("profile") + f"SELECT flow_id, {_ERROR} AS error, flow_id % 40 = 3 AS skipped FROM profile WHERE {_ERROR} IS NOT NULL"),
    "profile_parse_summary": (_profile_summary, cte("profile") + f"""SELECT count(*) FILTER (e IS NULL) AS parsed, CAST(sum(packets + packets_rev) FILTER (e IS NULL) AS BIGINT) AS packets,
        CAST(sum(bytes + bytes_rev) FILTER (e IS NULL) AS BIGINT) AS bytes, count(*) FILTER (flow_id % 40 = 3) AS skipped,
        count(*) FILTER (e IS NOT NULL AND flow_id % 40 <> 3) AS failed FROM (SELECT *, {_ERROR} AS e FROM profile)"""),
    "profile_strict": (_profile_strict, cte("profile") + """SELECT flow_id, CASE flow_id % 20 WHEN 1 THEN 'no packets' ELSE 'no bytes' END AS error
        FROM profile WHERE flow_id % 20 IN (1, 2)"""),
    "run_log_totals": (_run_logs, """SELECT CAST(user_id AS VARCHAR) AS file, max(event_id) FILTER (event_type = 'click') AS packets,
        max(event_id * 64) FILTER (event_type = 'click') AS bytes, min(event_id) FILTER (event_type = 'view') AS start_time,
        min(event_id + 7) FILTER (event_type = 'error') AS end_time FROM events GROUP BY user_id"""),
}
