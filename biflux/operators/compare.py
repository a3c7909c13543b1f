"""Comparison of an exported flow table with the expected one: by totals and flow by flow."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from biflux.functions.ip import ip_format
from biflux.functions.keys import with_canonical_key
from biflux.functions.scalars import rel_diff_truncated
from biflux.operators.segments import COMPLEMENT, Segment, complement, in_any, segment_label, segment_predicate
from biflux.schemas import FLOW_KEY, FlowDataError

DEFAULT_OK_TIME_DIFF = 100
METRICS = ("PACKETS", "BYTES", "FLOWS", "PPS", "MBPS", "DURATION")
_RULES_PER_PASS = 64


@dataclass(frozen=True)
class RunStats:
    """Totals of a replay run; times are epoch ms, a zero start means that the reference is absolute already."""

    packets: int = 0
    bytes: int = 0
    start_time: int = 0
    end_time: int = 0

    @property
    def seconds(self) -> float:
        return (self.end_time - self.start_time + 1) / 1000


@dataclass(frozen=True)
class Metric:
    key: str
    tolerance: float

    def __post_init__(self):
        if self.key not in METRICS:
            raise FlowDataError(f"unknown metric {self.key}")
        if not 0 <= self.tolerance <= 1:
            raise FlowDataError(f"tolerance {self.tolerance} is outside 0..1")


@dataclass(frozen=True)
class Rule:
    metrics: list[Metric] = field(default_factory=list)
    segment: Segment = None

    def __post_init__(self):
        keys = [m.key for m in self.metrics]
        if len(set(keys)) != len(keys):
            raise FlowDataError(f"rule contains duplicated metrics: {keys}")


def drop_before_start(flows: DataFrame, start_time: int) -> DataFrame:
    return flows.where(F.col("start_time") >= start_time) if start_time > 0 else flows


def add_run_start(reference: DataFrame, start_time: int) -> DataFrame:
    if start_time <= 0:
        return reference
    return reference.withColumns({c: F.col(c) + start_time for c in ("start_time", "end_time")})


def drop_multicast(flows: DataFrame) -> DataFrame:
    """Drop the IPv4 broadcast and the link-local IPv6 multicast destinations whose text begins with ``ff02::``."""
    multicast = (F.length("dst_ip") == 32) & F.when(F.col("dst_ip").startswith("ff020000"), ip_format(F.col("dst_ip")).startswith("ff02::")).otherwise(False)
    return flows.where((F.col("dst_ip") != "ffffffff") & ~multicast)


def merge_flows(flows: DataFrame) -> DataFrame:
    """Put partial flows of one 5-tuple together and count them."""
    return flows.groupBy(*FLOW_KEY).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
        F.count("*").alias("flow_count"),
    )


def duplicate_keys(reference: DataFrame) -> DataFrame:
    """5-tuples that occur more than once; must be empty before partial flows may be merged."""
    return reference.groupBy(*FLOW_KEY).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def biflow_time_correction(merged: DataFrame) -> DataFrame:
    """Give both directions of a biflow the earliest start and the latest end.

    The input has unique 5-tuples, so a direction-free key has two rows at most. Equal addresses are not swapped: each
    port order keeps its own key there.
    """
    both = Window.partitionBy("a_ip", "b_ip", "a_port", "b_port", "protocol")
    return with_canonical_key(merged).withColumns({
        "start_time": F.min("start_time").over(both), "end_time": F.max("end_time").over(both),
    }).select(*merged.columns)


def prepare(
    flows: DataFrame,
    reference: DataFrame,
    stats: RunStats = RunStats(),
    merge: bool = False,
    biflows_ts_correction: bool = False,
    check_unique: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Bring both tables to the form the comparisons expect."""
    reference = add_run_start(reference, stats.start_time)
    flows = drop_multicast(drop_before_start(flows, stats.start_time))
    if merge:
        if check_unique and not duplicate_keys(reference).isEmpty():
            raise FlowDataError("cannot merge flows, duplicated key in the reference")
        flows = merge_flows(flows)
        if biflows_ts_correction:
            flows = biflow_time_correction(flows)
    return flows, reference


def _totals(df: DataFrame, rules: list[tuple[int, Rule]], prefix: str) -> DataFrame:
    """One row per rule, all rules folded into one conditional aggregation."""
    aggregates, entries = [], []
    for i, rule in rules:
        def inside(value: Column, rule=rule) -> Column:
            return value if rule.segment is None else F.when(rule.segment.predicate(), value)

        aggregates += [
            F.sum(inside(F.col("packets"))).alias(f"p{i}"), F.sum(inside(F.col("bytes"))).alias(f"b{i}"),
            F.count(inside(F.lit(1))).alias(f"n{i}"),
            F.min(inside(F.col("start_time"))).alias(f"s{i}"), F.max(inside(F.col("end_time"))).alias(f"e{i}"),
        ]
        entries.append(F.struct(
            F.lit(i).alias("rule_id"),
            F.coalesce(F.col(f"p{i}"), F.lit(0)).alias(f"{prefix}_packets"),
            F.coalesce(F.col(f"b{i}"), F.lit(0)).alias(f"{prefix}_bytes"),
            F.col(f"n{i}").alias(f"{prefix}_flows"),
            ((F.col(f"e{i}") - F.col(f"s{i}") + 1) / 1000).alias(f"{prefix}_seconds"),
        ))
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def stat_compare(
    flows: DataFrame,
    reference: DataFrame,
    rules: list[Rule],
    stats: RunStats = RunStats(),
    check_complement: bool = False,
) -> DataFrame:
    """Compare totals per rule: ``rule_id, segment, metric, value, reference, diff, tolerance, passed``.

    PPS, MBPS (bytes / 1e6 per second) and DURATION are compared with the totals of the whole run, also inside a
    segment. A zero reference has no relative difference; the test passes if the value is zero as well.
    """
    numbered = list(enumerate(rules))
    tests = []
    for at in range(0, len(numbered), _RULES_PER_PASS):
        part = numbered[at:at + _RULES_PER_PASS]
        both = _totals(flows, part, "v").join(_totals(reference, part, "r"), "rule_id")
        run = F.lit(float(stats.seconds))
        sides = {
            "PACKETS": ("v_packets", "r_packets"), "BYTES": ("v_bytes", "r_bytes"), "FLOWS": ("v_flows", "r_flows"),
        }
        values = {m: (F.col(v).cast("double"), F.col(r).cast("double")) for m, (v, r) in sides.items()}
        values["PPS"] = (F.col("v_packets") / F.col("v_seconds"), F.lit(float(stats.packets)) / run)
        values["MBPS"] = (F.col("v_bytes") / F.col("v_seconds") / 1e6, F.lit(float(stats.bytes)) / run / 1e6)
        values["DURATION"] = (F.col("v_seconds"), run)
        chosen = F.create_map(*[
            x for i, rule in part for x in (F.lit(i), F.array(*[
                F.struct(
                    F.lit(segment_label(rule.segment)).alias("segment"), F.lit(m.key).alias("metric"),
                    F.coalesce(values[m.key][0], F.lit(0.0)).alias("value"), values[m.key][1].alias("reference"),
                    F.lit(float(m.tolerance)).alias("tolerance"),
                ) for m in rule.metrics
            ]))
        ])
        tests.append(both.select("rule_id", F.inline(chosen[F.col("rule_id")])))
    result = tests[0]
    for more in tests[1:]:
        result = result.unionByName(more)
    result = result.withColumn("diff", rel_diff_truncated(F.col("value"), F.col("reference")))
    result = result.withColumn(
        "passed", F.when(F.col("diff").isNull(), F.col("value") == 0).otherwise(F.col("diff") <= F.col("tolerance"))
    )
    columns = ["rule_id", "segment", "metric", "value", "reference", "diff", "tolerance", "passed"]
    result = result.select(*columns)
    if check_complement:
        left = complement(flows, [r.segment for r in rules]).agg(
            F.coalesce(F.sum("packets"), F.lit(0)).cast("double").alias("PACKETS"),
            F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("BYTES"),
        )
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("PACKETS", "BYTES")])
        rest = left.select(F.inline(pairs)).select(
            F.lit(len(rules)).alias("rule_id"), F.lit(COMPLEMENT).alias("segment"), "metric", "value",
            F.lit(0.0).alias("reference"), F.when(F.col("value") == 0, 0.0).otherwise(1.0).alias("diff"),
            F.lit(0.0).alias("tolerance"), (F.col("value") == 0).alias("passed"),
        )
        result = result.unionByName(rest)
    return result


def stat_verdict(results: DataFrame) -> DataFrame:
    """Passed overall, number of tests and failed tests."""
    return results.agg(
        F.bool_and("passed").alias("passed"), F.count("*").alias("tests"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def failed_tests(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed"))


def lookup_tests(results: DataFrame, segment: Segment = None, metric: str | None = None) -> DataFrame:
    found = results.where(F.col("segment") == segment_label(segment))
    return found if metric is None else found.where(F.col("metric") == metric)


def _category(active_timeout: int, ok_time_diff: int) -> Column:
    expected_parts = 1 + F.floor((F.col("r.end_time") - F.col("r.start_time")) / (active_timeout * 1000 + 1))
    scaled = (F.col("f.packets") != F.col("r.packets")) | (F.col("f.bytes") != F.col("r.bytes"))
    return (
        F.when(~F.col("has_flow"), "missing")
        .when(~F.col("has_ref"), "unexpected")
        .when(scaled, "scaled")
        .when(F.col("time_diff") > ok_time_diff, "shifted")
        .when(F.col("f.flow_count") != expected_parts, "split")
        .otherwise("ok")
    )


def precise_compare(
    merged: DataFrame,
    reference: DataFrame,
    active_timeout: int = 300,
    ok_time_diff: int = DEFAULT_OK_TIME_DIFF,
    segments: list[Segment] | None = None,
    check_complement: bool = False,
) -> DataFrame:
    """Classify every flow per segment: missing, unexpected, scaled, shifted, split or ok.

    ``merged`` comes from :func:`merge_flows`. One full outer join serves all segments; each side carries the numbers of
    the segments it lies in, because a time segment may take a flow but not its reference.
    """
    segments = [None] if segments is None else segments
    if len({segment_label(s) for s in segments}) != len(segments):
        raise FlowDataError("a segment is given twice")

    def tagged(df: DataFrame, name: str) -> DataFrame:
        values = [c for c in df.columns if c not in FLOW_KEY]
        if segments == [None]:
            return df.select(*FLOW_KEY, F.struct(*values).alias(name), F.array(F.lit(0)).alias(f"{name}_in"))
        members = [F.when(segment_predicate(s), F.lit(i)) for i, s in enumerate(segments)]
        if name == "f" and check_complement:
            members.append(F.when(~in_any(segments), F.lit(len(segments))))
        inside = F.array_compact(F.array(*members))
        marked = df.select(*FLOW_KEY, F.struct(*values).alias(name), inside.alias(f"{name}_in"))
        # A row outside of every segment cannot show up in any result.
        return marked.where(F.size(f"{name}_in") > 0)

    left, right = tagged(merged, "f"), tagged(reference, "r")
    none = F.array().cast("array<int>")
    both = left.join(right, FLOW_KEY, "full_outer").withColumns({
        "f_in": F.coalesce("f_in", none), "r_in": F.coalesce("r_in", none),
    })
    per_segment = both.withColumn("segment_id", F.explode_outer(F.array_union("f_in", "r_in"))).withColumns({
        "has_flow": F.array_contains("f_in", F.col("segment_id")),
        "has_ref": F.array_contains("r_in", F.col("segment_id")),
        "time_diff": F.greatest(
            F.abs(F.col("f.start_time") - F.col("r.start_time")), F.abs(F.col("f.end_time") - F.col("r.end_time"))
        ),
    })
    labels = [segment_label(s) for s in segments] + [COMPLEMENT]
    return per_segment.select(
        F.array(*[F.lit(x) for x in labels])[F.col("segment_id")].alias("segment"),
        _category(active_timeout, ok_time_diff).alias("category"),
        *FLOW_KEY,
        F.when(F.col("has_flow"), F.col("f")).alias("flow"),
        F.when(F.col("has_ref"), F.col("r")).alias("ref"),
        F.when(F.col("has_flow") & F.col("has_ref"), F.col("time_diff")).alias("time_diff"),
        F.when(F.col("has_flow"), F.col("f.flow_count")).alias("flow_count"),
    )


CATEGORIES = ["missing", "unexpected", "scaled", "shifted", "split", "ok"]


def precise_summary(results: DataFrame) -> DataFrame:
    """Counts per segment and category; a split flow does not fail a segment."""
    counted = results.groupBy("segment").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    errors = F.col("missing") + F.col("unexpected") + F.col("scaled") + F.col("shifted")
    return counted.withColumn("passed", errors == 0)


def precise_errors(results: DataFrame, category: str, limit: int = 100) -> DataFrame:
    """First flows of one category for printing; split flows with the most parts come first."""
    found = results.where(F.col("category") == category)
    if category == "split":
        found = found.orderBy(F.col("flow_count").desc(), *FLOW_KEY)
    return found.limit(limit)
