"""Registered queries over the profile operators."""

from pyspark.sql import functions as F

from biflux.functions.keys import flip_ephemeral
from biflux.operators import profile_build, profile_enrich, profile_metrics, profile_sample, profile_trim
from biflux.operators.profile_trim import TrimSpec
from biflux.plans.views import cte, view
from biflux.schemas import PROFILE_COLUMNS


def _profile(spark, sf_dir):
    return view(spark, sf_dir, "profile")


def _metrics(spark, sf_dir, where=None, **options):
    profile = _profile(spark, sf_dir)
    span = profile_metrics.profile_span(profile)
    part = profile if where is None else profile.where(where)
    return profile_metrics.metric_table(part, span, **options)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _group(*groups):
    def run(spark, sf_dir):
        found = _metrics(spark, sf_dir).where(F.col("grp").isin(*groups))
        return _rounded(found, "value")
    return run


def _metric_sql(profile: str = "profile", name: str = "m", proto: float = 0.005, port: float = 0.005) -> dict[str, str]:
    """Named queries: all metric groups of a profile over the span of the full profile."""
    return {
        f"{name}_tot": f"""SELECT CAST(sum(packets + packets_rev) AS DOUBLE) AS p, CAST(sum(bytes + bytes_rev) AS DOUBLE) AS b,
            CAST(count(*) AS DOUBLE) AS n FROM {profile}""",
        f"{name}_span": """SELECT min(start_time) AS first, greatest(CAST(ceil(ceil((max(end_time) - min(start_time)) / 1000) / 5) AS BIGINT), 1) AS nw FROM profile""",
        f"{name}_one": f"""SELECT start_time - first AS s, end_time - first AS e, packets + packets_rev AS p,
            least((start_time - first) // 5000, nw - 1) AS w1, least((end_time - first) // 5000, nw - 1) AS w2 FROM {profile}, {name}_span""",
        f"{name}_win": f"""SELECT w, sum(CASE WHEN s = e THEN CAST(p AS DOUBLE)
              ELSE greatest(least((w + 1) * 5000, e) - greatest(w * 5000, s), 0)::DOUBLE / (e - s) * p END) AS pk
            FROM (SELECT *, unnest(generate_series(w1, w2)) AS w FROM {name}_one) GROUP BY w""",
        f"{name}": f"""
          SELECT 'ratio' AS grp, 'pkts_bts' AS name, p / b AS value FROM {name}_tot
          UNION ALL SELECT 'ratio', 'bfls_pkts', n / p FROM {name}_tot UNION ALL SELECT 'ratio', 'bfls_bts', n / b FROM {name}_tot
          UNION ALL SELECT 'l3', l3_proto::VARCHAR, count(*) / any_value(n) FROM {profile}, {name}_tot GROUP BY l3_proto
          UNION ALL SELECT 'size', c, count(*) / any_value(n) FROM (SELECT CASE WHEN a <= 128 THEN 'small' WHEN a <= 512 THEN 'medium'
              WHEN a <= 1024 THEN 'large' ELSE 'huge' END AS c FROM (SELECT (bytes + bytes_rev) // (packets + packets_rev) AS a FROM {profile})), {name}_tot GROUP BY c
          UNION ALL SELECT 'proto', l4_proto::VARCHAR, count(*) / any_value(n) FROM {profile}, {name}_tot GROUP BY l4_proto HAVING count(*) / any_value(n) >= {proto}
          UNION ALL SELECT 'port', port::VARCHAR, count(*) / any_value(2 * n) FROM (SELECT unnest([src_port, dst_port]) AS port FROM {profile}), {name}_tot
            GROUP BY port HAVING count(*) / any_value(2 * n) >= {port}
          UNION ALL SELECT 'window', i::VARCHAR, coalesce(pk, 0) / p FROM (SELECT unnest(generate_series(0, nw - 1)) AS i FROM {name}_span)
            LEFT JOIN {name}_win ON w = i, {name}_tot""",
    }


def _group_sql(*groups: str) -> str:
    listed = ", ".join(f"'{g}'" for g in groups)
    return cte("profile", **_metric_sql()) + f"SELECT grp, name, round(value, 6) AS value FROM m WHERE grp IN ({listed})"


def _window_rsd(spark, sf_dir):
    profile = _profile(spark, sf_dir)
    span = profile_metrics.profile_span(profile)
    return _rounded(profile_metrics.window_rsd(profile_metrics.metric_table(profile, span), span), "rsd")


_MASK = "flow_id % 3 = 0"
_DIFF_SQL = {
    **_metric_sql(), "part": f"SELECT * FROM profile WHERE {_MASK}",
    **_metric_sql("part", "s", 0, 0),
    "diff": """SELECT grp, name, m.value AS original, coalesce(s.value, 0) AS solution,
        CASE WHEN m.value <> 0 THEN abs(coalesce(s.value, 0) - m.value) * 100 / m.value WHEN coalesce(s.value, 0) = 0 THEN 0 ELSE 100 END AS diff
        FROM m LEFT JOIN s USING (grp, name)""",
}


def _diff(spark, sf_dir):
    return profile_metrics.metric_diff(
        _metrics(spark, sf_dir), _metrics(spark, sf_dir, _MASK, proto_threshold=0.0, port_threshold=0.0))


def _sample_diff(spark, sf_dir):
    return _rounded(_diff(spark, sf_dir), "original", "solution").withColumn("diff", F.round("diff", 3))


def _fitness(spark, sf_dir):
    return _rounded(profile_metrics.fitness(_diff(spark, sf_dir), 0.05), "fitness").withColumn("worst", F.round("worst", 6))


def _report_totals(spark, sf_dir):
    profile = _profile(spark, sf_dir)
    report = profile_sample.sample_report(profile, profile.where(_MASK))
    return _rounded(report, "original", "solution").withColumn("diff", F.round("diff", 3))


def _top_ports(spark, sf_dir):
    return _rounded(profile_metrics.top_share(_metrics(spark, sf_dir, port_threshold=0.0), "port", 5), "value")


def _timeline(spark, sf_dir):
    series = profile_metrics.timeline(_profile(spark, sf_dir)).drop("active")
    return series.withColumns({c: F.round(F.col(c).cast("decimal(38,16)"), 6).cast("double") for c in ("kpps", "mbps")})


def _active(spark, sf_dir):
    return profile_metrics.timeline(_profile(spark, sf_dir)).select("second", "active")


_TIME_SQL = {
    "sec": "SELECT start_time // 1000 AS a, end_time // 1000 AS b, packets + packets_rev AS p, bytes + bytes_rev AS y FROM profile",
    "axis": "SELECT unnest(generate_series((SELECT min(a) FROM sec), (SELECT max(b) FROM sec) + 30)) AS second",
}

TRIM = TrimSpec(tolerance=200_000, left=700_000, right=1_700_000)
_TRIM_CASE = """CASE WHEN start_time >= 700000 AND end_time <= 1700000 THEN 'nonaltered'
  WHEN (start_time >= 500000 AND end_time <= 700000 AND start_time <> 700000)
    OR (start_time >= 1700000 AND end_time <= 1900000 AND end_time <> 1700000) THEN 'tolerance'
  WHEN (start_time < 500000 AND end_time < 700000) OR (start_time > 1700000 AND end_time > 1900000) THEN 'dropped'
  ELSE 'scaled' END"""


def _trim_categories(spark, sf_dir):
    return profile_trim.with_trim_category(_profile(spark, sf_dir), TRIM).select("flow_id", "category")


def _trim(spark, sf_dir):
    return profile_trim.trim(_profile(spark, sf_dir), TRIM, "flow_id", seed=7)


def _trim_checks(spark, sf_dir):
    """What must hold for any random draw: exact counts per category, borders kept, and each row within what its original allows."""
    same = ["start_time", "end_time", "packets", "bytes", "packets_rev", "bytes_rev"]
    before = _profile(spark, sf_dir).select("flow_id", *[F.col(c).alias(f"o_{c}") for c in same])
    rows = _trim(spark, sf_dir).join(before, "flow_id")
    start, end, first, last = (F.col(c) for c in ("start_time", "end_time", "o_start_time", "o_end_time"))
    starts = F.when(first < 700_000, start.between(F.greatest(first, F.lit(500_000)), 700_000)).otherwise(start == first)
    ends = F.when(F.col("packets") + F.col("packets_rev") == 1, end == start).when(
        last > 1_700_000, end.between(1_700_000, F.least(last, F.lit(1_900_000)))).otherwise(end == last)
    fewer = F.lit(True)
    for p, b in (("packets", "bytes"), ("packets_rev", "bytes_rev")):
        silent = (F.col(f"o_{p}") == 0) & (F.col(f"o_{b}") == 0)
        fewer = fewer & F.when(silent, (F.col(p) == 0) & (F.col(b) == 0)).otherwise(
            F.col(p).between(1, F.col(f"o_{p}")) & (F.col(b) > 0) & (F.col(b) <= F.greatest(F.col(f"o_{b}"), F.lit(profile_trim.MIN_BYTES))))
    unchanged = F.forall(F.array(*[F.col(c) == F.col(f"o_{c}") for c in same]), lambda x: x)
    sound = F.when(F.col("category") == "scaled", starts & ends & fewer).otherwise(unchanged)
    return rows.groupBy("category").agg(
        F.count("*").alias("flows"), (F.min("start_time") >= 500_000).alias("after_left"), (F.max("end_time") <= 1_900_000).alias("before_right"),
        F.bool_and(sound).alias("sound"))


def _trim_statistics(spark, sf_dir):
    marked = profile_trim.with_trim_category(_profile(spark, sf_dir), TRIM)
    return profile_trim.trim_statistics(marked, profile_trim.trim(_profile(spark, sf_dir), TRIM, "flow_id", seed=7))


def _trim_inside(spark, sf_dir):
    """The statistics with the untouched rows as the trimmed profile: nothing random in it."""
    marked = profile_trim.with_trim_category(_profile(spark, sf_dir), TRIM)
    return profile_trim.trim_statistics(marked, marked.where(F.col("category") == "nonaltered"))


_INSIDE_SQL = cte("profile", marked=f"SELECT *, {_TRIM_CASE} AS category FROM profile", totals="""
  SELECT count(*) AS n, sum(packets)::BIGINT AS p, sum(bytes)::BIGINT AS b, sum(packets_rev)::BIGINT AS pr, sum(bytes_rev)::BIGINT AS br,
    count(*) FILTER (category = 'nonaltered') AS kn, count(*) FILTER (category = 'scaled') AS altered,
    (sum(packets) FILTER (category = 'nonaltered'))::BIGINT AS kp, (sum(bytes) FILTER (category = 'nonaltered'))::BIGINT AS kb,
    (sum(packets_rev) FILTER (category = 'nonaltered'))::BIGINT AS kpr, (sum(bytes_rev) FILTER (category = 'nonaltered'))::BIGINT AS kbr FROM marked""",
  items="""SELECT 'flows' AS item, n AS original, kn AS trimmed, n AS d FROM totals UNION ALL SELECT 'packets', p, kp, p FROM totals
    UNION ALL SELECT 'bytes', b, kb, b FROM totals UNION ALL SELECT 'packets_rev', pr, kpr, pr FROM totals UNION ALL SELECT 'bytes_rev', br, kbr, br FROM totals
    UNION ALL SELECT 'nonaltered', 0, kn, n FROM totals UNION ALL SELECT 'altered', 0, altered, n FROM totals UNION ALL SELECT 'dropped', 0, n - kn, n FROM totals""") + """
  SELECT item, original, trimmed, CASE WHEN d = 0 THEN 0 ELSE round(trimmed / d, 2) END AS ratio FROM items"""


def _sample(spark, sf_dir):
    chosen, _ = profile_sample.sample(_profile(spark, sf_dir), "flow_id", 0.2, 0.4, candidates=8, seed=3)
    return chosen.select(*PROFILE_COLUMNS)


def _scores(spark, sf_dir):
    return profile_sample.score_candidates(_profile(spark, sf_dir), "flow_id", 0.2, 0.4, candidates=8, seed=3)


#: Given samples: a share of all rows, one of the early ones, one that leaves a protocol out, and no row.
_GIVEN = ["flow_id % 3 = 0", "flow_id % 4 = 1 AND start_time < 900000", "l4_proto = 6 AND flow_id % 2 = 0", "flow_id < 0"]


def _given_sql() -> str:
    parts, rows = dict(_metric_sql()), []
    for k, condition in enumerate(_GIVEN):
        parts |= {f"part{k}": f"SELECT * FROM profile WHERE {condition}", **_metric_sql(f"part{k}", f"s{k}", 0, 0)}
        rows.append(f"""SELECT {k} AS candidate, (SELECT n FROM s{k}_tot) / (SELECT n FROM m_tot) AS share, grp, CASE WHEN m.value <> 0
            THEN abs(coalesce(s.value, 0) - m.value) * 100 / m.value WHEN coalesce(s.value, 0) = 0 THEN 0 ELSE 100 END AS diff FROM m LEFT JOIN s{k} s USING (grp, name)""")
    return cte("profile", **parts, diffs=" UNION ALL ".join(rows)) + """SELECT candidate, round(any_value(share), 6) AS share,
        round(greatest((100 - sum(diff * diff) FILTER (grp <> 'window')) / 2 + (100 - pow(avg(diff) FILTER (grp = 'window'), 2)) / 2, 0), 6) AS fitness,
        round(max(diff), 6) AS worst, max(diff) <= 5 AS accepted FROM diffs WHERE share > 0 GROUP BY candidate"""


def _given(spark, sf_dir):
    profile = _profile(spark, sf_dir)
    span = profile_metrics.profile_span(profile)
    scores = profile_sample.score_members(profile, profile, {k: F.expr(c) for k, c in enumerate(_GIVEN)}, span, 0.05)
    return _rounded(scores, "share", "fitness").withColumn("worst", F.round("worst", 6))


V4_RANGES, V6_RANGES = ["10.0.0.0/8 30%", "172.16.0.0/13", "192.0.2.7/32 20%"], ["2001:db8::/33 60%", "2001:db8:8000::/35"]


def _enrich(spark, sf_dir):
    return profile_enrich.enrich(_profile(spark, sf_dir), "flow_id", V4_RANGES, V6_RANGES, seed=11)


def _enrich_checks(spark, sf_dir):
    """What must hold for any draw: every row has addresses of its version, all direction-free keys differ."""
    rows = profile_enrich.with_canonical_key(_enrich(spark, sf_dir), tie_on_port=True)
    key = F.struct("a_ip", "b_ip", "a_port", "b_port", "l4_proto")
    return rows.groupBy("l3_proto").agg(
        F.count("*").alias("flows"), F.count_distinct(key).alias("keys"), F.max(F.length("src_ip")).alias("width"),
        F.count_if(F.length("dst_ip") != F.length("src_ip")).alias("mixed"))


def _records(spark, sf_dir):
    return profile_build.to_ms(view(spark, sf_dir, "raw_flows"))


def _build(spark, sf_dir):
    return profile_build.build_profile(_records(spark, sf_dir))


def _build_totals(spark, sf_dir):
    return _build(spark, sf_dir).groupBy("l4_proto").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.sum(F.col("packets") + F.col("packets_rev")).alias("packets"), F.sum(F.col("bytes") + F.col("bytes_rev")).alias("bytes"))


_MS_SQL = """SELECT CAST(trunc(start_time * 1000) AS BIGINT) AS s, CAST(trunc(duration * 1000) AS BIGINT) AS d, * EXCLUDE (start_time, duration) FROM raw_flows"""
_BASE_SQL = "SELECT arg_min(s, arrival_seq) AS z, min(arrival_seq) AS a FROM ms WHERE s <> 0"
_RECORDS_SQL = """SELECT arrival_seq, s - CASE WHEN arrival_seq >= a THEN z ELSE 0 END AS st, s + d - CASE WHEN arrival_seq >= a THEN z ELSE 0 END AS en,
    proto, src_ip, dst_ip, CASE WHEN proto IN (6, 17) THEN src_port ELSE 0 END AS sp, CASE WHEN proto IN (6, 17) THEN dst_port ELSE 0 END AS dp, packets, bytes,
    src_ip > dst_ip AS swap FROM ms, base"""
#: The fold of each key, one record of every key at a step; ``done`` is the flow that a record closes.
_FOLD_SQL = {
    "ms": _MS_SQL, "base": _BASE_SQL, "recs": _RECORDS_SQL,
    "numbered": """SELECT *, row_number() OVER (PARTITION BY a, b, ap, bp, proto ORDER BY arrival_seq) AS n FROM (
      SELECT *, CASE WHEN swap THEN dst_ip ELSE src_ip END AS a, CASE WHEN swap THEN src_ip ELSE dst_ip END AS b, CASE WHEN swap THEN dp ELSE sp END AS ap,
        CASE WHEN swap THEN sp ELSE dp END AS bp FROM recs)""",
    "keyed": "SELECT *, dense_rank() OVER (ORDER BY a, b, ap, bp, proto) AS k FROM numbered",
    "folded": """SELECT k, n, {'s': st, 'e': en, 'w': swap, 'p0': CASE WHEN swap THEN 0 ELSE packets END, 'b0': CASE WHEN swap THEN 0 ELSE bytes END,
        'p1': CASE WHEN swap THEN packets ELSE 0 END, 'b1': CASE WHEN swap THEN bytes ELSE 0 END, 'r': false} AS f,
        CAST(NULL AS STRUCT(s BIGINT, e BIGINT, w BOOLEAN, p0 BIGINT, b0 BIGINT, p1 BIGINT, b1 BIGINT, r BOOLEAN)) AS done FROM keyed WHERE n = 1
      UNION ALL SELECT k, n, CASE WHEN takes THEN {'s': least(f.s, st), 'e': greatest(f.e, en), 'w': f.w, 'p0': f.p0 + CASE WHEN swap THEN 0 ELSE packets END,
          'b0': f.b0 + CASE WHEN swap THEN 0 ELSE bytes END, 'p1': f.p1 + CASE WHEN swap THEN packets ELSE 0 END, 'b1': f.b1 + CASE WHEN swap THEN bytes ELSE 0 END,
          'r': f.r OR (swap <> f.w AND packets > 0)}
        ELSE {'s': st, 'e': en, 'w': swap, 'p0': CASE WHEN swap THEN 0 ELSE packets END, 'b0': CASE WHEN swap THEN 0 ELSE bytes END,
          'p1': CASE WHEN swap THEN packets ELSE 0 END, 'b1': CASE WHEN swap THEN bytes ELSE 0 END, 'r': false} END, CASE WHEN NOT takes THEN f END
      FROM (SELECT c.k, x.n, c.f, x.st, x.en, x.swap, x.packets, x.bytes,
          (NOT c.f.r AND x.swap <> c.f.w AND x.st <= c.f.e + 30000 AND x.en + 30000 >= c.f.s) OR (x.packets = 1 AND abs(x.st - c.f.e) < 30000)
          OR (c.f.e - c.f.s >= 270000 AND x.st <= c.f.e + 30000) AS takes
        FROM folded c JOIN keyed x ON x.k = c.k AND x.n = c.n + 1)""",
    "flows": """SELECT k, unnest([done, CASE WHEN n = max(n) OVER (PARTITION BY k) THEN f END]) AS f FROM folded""",
}
def profile_sql(records: str = "SELECT * FROM recs0") -> str:
    """The profile of all records, or of another selection of them."""
    parts = {**{k: _FOLD_SQL[k] for k in ("ms", "base")}, "recs0": _RECORDS_SQL, **_FOLD_SQL, "recs": records}
    return cte("raw_flows", **parts).replace("WITH", "WITH RECURSIVE", 1) + """SELECT f.s AS start_time, f.e AS end_time, CAST(4 AS INTEGER) AS l3_proto, proto AS l4_proto,
    CAST(CASE WHEN f.w THEN bp ELSE ap END AS INTEGER) AS src_port, CAST(CASE WHEN f.w THEN ap ELSE bp END AS INTEGER) AS dst_port, CASE WHEN f.w THEN f.p1 ELSE f.p0 END AS packets,
    CASE WHEN f.w THEN f.b1 ELSE f.b0 END AS bytes, CASE WHEN f.w THEN f.p0 ELSE f.p1 END AS packets_rev, CASE WHEN f.w THEN f.b0 ELSE f.b1 END AS bytes_rev
  FROM flows JOIN (SELECT DISTINCT k, proto, ap, bp FROM keyed) USING (k) WHERE f IS NOT NULL"""


def _raw_times(spark, sf_dir):
    return _records(spark, sf_dir).select("arrival_seq", "start_time", "end_time")


QUERIES = {
    "profile_metrics": (_group("ratio", "l3", "size"), _group_sql("ratio", "l3", "size")),
    "proto_share": (_group("proto"), _group_sql("proto")),
    "port_share": (_group("port"), _group_sql("port")),
    "window_share": (_group("window"), _group_sql("window")),
    "window_rsd": (_window_rsd, cte("profile", **_metric_sql()) + """SELECT round(sqrt(avg((value - mean) * (value - mean))) / any_value(mean), 6) AS rsd
        FROM m, (SELECT 1.0::DOUBLE / nw AS mean FROM m_span) WHERE grp = 'window'"""),
    "top_ports": (_top_ports, cte("profile", **_metric_sql(port=0.0)) + """SELECT grp, name, round(value, 6) AS value FROM m WHERE grp = 'port'
        ORDER BY m.value DESC, name LIMIT 5"""),
    "sample_diff": (_sample_diff, cte("profile", **_DIFF_SQL) + """SELECT grp, name, round(original, 6) AS original, round(solution, 6) AS solution,
        round(diff, 3) AS diff FROM diff"""),
    "sample_fitness": (_fitness, cte("profile", **_DIFF_SQL) + """SELECT round(greatest((100 - sum(diff * diff) FILTER (grp <> 'window')) / 2
          + (100 - pow(avg(diff) FILTER (grp = 'window'), 2)) / 2, 0), 6) AS fitness, round(max(diff), 6) AS worst, max(diff) <= 5 AS accepted FROM diff"""),
    "sample_report": (_report_totals, cte("profile", **_DIFF_SQL) + """SELECT grp, name, round(original, 6) AS original, round(solution, 6) AS solution,
        round(diff, 3) AS diff FROM diff
        UNION ALL SELECT 'total', 'packets', NULL, p, NULL FROM s_tot UNION ALL SELECT 'total', 'bytes', NULL, b, NULL FROM s_tot
        UNION ALL SELECT 'total', 'flows', NULL, n, NULL FROM s_tot"""),
    "sample_scores": (_scores, None),
    "sample_scores_given": (_given, _given_sql()),
    "sample_profile": (_sample, None),
    "timeline": (_timeline, cte("profile", **_TIME_SQL, per="""SELECT second, sum(CAST(p / (b - a + 1) / 1000 AS DECIMAL(38,16))) AS kpps, sum(CAST(y * 8 / (b - a + 1) / (1024 * 1024) AS DECIMAL(38,16))) AS mbps
          FROM (SELECT *, unnest(generate_series(a, b)) AS second FROM sec) GROUP BY second""",
        st="SELECT a AS second, count(*) AS starts FROM sec GROUP BY a", en="SELECT b AS second, count(*) AS ends FROM sec GROUP BY b") + """
        SELECT second, CAST(round(coalesce(kpps, 0), 6) AS DOUBLE) AS kpps, CAST(round(coalesce(mbps, 0), 6) AS DOUBLE) AS mbps, coalesce(starts, 0) AS starts, coalesce(ends, 0) AS ends
        FROM axis LEFT JOIN per USING (second) LEFT JOIN st USING (second) LEFT JOIN en USING (second)"""),
    "active_flows": (_active, cte("profile", **_TIME_SQL, per="""SELECT second, count(*) AS active
          FROM (SELECT unnest(generate_series(a, b + 30)) AS second FROM sec) GROUP BY second""") + """
        SELECT second, coalesce(active, 0) AS active FROM axis LEFT JOIN per USING (second)"""),
    "profile_flip": (lambda s, d: flip_ephemeral(_profile(s, d)), cte("profile", f="SELECT *, src_port < 32768 AND dst_port >= 32768 AS flip FROM profile") + """
        SELECT flow_id, start_time, end_time, l3_proto, l4_proto, CASE WHEN flip THEN dst_port ELSE src_port END AS src_port,
          CASE WHEN flip THEN src_port ELSE dst_port END AS dst_port, CASE WHEN flip THEN packets_rev ELSE packets END AS packets,
          CASE WHEN flip THEN bytes_rev ELSE bytes END AS bytes, CASE WHEN flip THEN packets ELSE packets_rev END AS packets_rev,
          CASE WHEN flip THEN bytes ELSE bytes_rev END AS bytes_rev, CASE WHEN flip THEN dst_ip ELSE src_ip END AS src_ip,
          CASE WHEN flip THEN src_ip ELSE dst_ip END AS dst_ip FROM f"""),
    "trim_categories": (_trim_categories, cte("profile") + f"SELECT flow_id, {_TRIM_CASE} AS category FROM profile"),
    "trim_profile": (_trim, None),
    "trim_half_exact": (_trim_checks, cte("profile", marked=f"SELECT *, {_TRIM_CASE} AS category FROM profile") + """
        SELECT category, CASE WHEN category = 'tolerance' THEN CAST(round_even(count(*) / 2, 0) AS BIGINT) ELSE count(*) END AS flows,
          true AS after_left, true AS before_right, true AS sound FROM marked WHERE category <> 'dropped' GROUP BY category"""),
    "trim_statistics": (_trim_statistics, None),
    "trim_statistics_inside": (_trim_inside, _INSIDE_SQL),
    "enrich_profile": (_enrich, None),
    "enrich_unique": (_enrich_checks, cte("profile") + """SELECT l3_proto, count(*) AS flows, count(*) AS keys,
        CASE l3_proto WHEN 4 THEN 8 ELSE 32 END AS width, CAST(0 AS BIGINT) AS mixed FROM profile GROUP BY l3_proto"""),
    "raw_flow_times": (_raw_times, cte("raw_flows", ms=_MS_SQL, base=_BASE_SQL) + """SELECT arrival_seq,
        s - CASE WHEN arrival_seq >= a THEN z ELSE 0 END AS start_time, s + d - CASE WHEN arrival_seq >= a THEN z ELSE 0 END AS end_time FROM ms, base"""),
    "build_profile": (_build, profile_sql()),
    "build_profile_totals": (_build_totals, cte("raw_flows", ms=_MS_SQL, base=_BASE_SQL) + """SELECT proto AS l4_proto, min(s) - any_value(z) AS start_time,
        max(s + d) - any_value(z) AS end_time, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM ms, base GROUP BY proto"""),
}
