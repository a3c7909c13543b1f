"""Segments of a flow table (subnets, time intervals, everything) as boolean columns."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from biflux.functions.ip import ip_in, network_bounds
from biflux.schemas import FlowDataError

COMPLEMENT = "COMPLEMENT OF SEGMENTS"
ALL = "ALL"


@dataclass(frozen=True)
class SubnetSegment:
    """Flows from ``source`` and to ``dest`` (either may be open); ``bidir`` also takes the opposite direction."""

    source: str | None = None
    dest: str | None = None
    bidir: bool = False

    def __post_init__(self):
        if self.source is None and self.dest is None:
            raise FlowDataError("a subnet segment needs a source or a destination")

    @property
    def label(self) -> str:
        arrow = "<->" if self.bidir else "->"
        return f"{self.source or '*'} {arrow} {self.dest or '*'}"

    def predicate(self) -> Column:
        def one_way(src: str, dst: str) -> Column:
            tests = [ip_in(F.col(c), net) for c, net in ((src, self.source), (dst, self.dest)) if net is not None]
            return reduce(Column.__and__, tests)

        forward = one_way("src_ip", "dst_ip")
        return forward | one_way("dst_ip", "src_ip") if self.bidir else forward


@dataclass(frozen=True)
class TimeSegment:
    """Flows lying fully inside ``[start, end]`` (epoch ms, either end may be open)."""

    start: int | None = None
    end: int | None = None

    def __post_init__(self):
        if self.start is None and self.end is None:
            raise FlowDataError("a time segment needs a start or an end")

    @property
    def label(self) -> str:
        return f"{'' if self.start is None else self.start} - {'' if self.end is None else self.end}"

    def predicate(self) -> Column:
        tests = []
        if self.start is not None:
            tests.append(F.col("start_time") >= self.start)
        if self.end is not None:
            tests.append(F.col("end_time") <= self.end)
        return reduce(Column.__and__, tests)


Segment = SubnetSegment | TimeSegment | None


def segment_label(segment: Segment) -> str:
    return ALL if segment is None else segment.label


def segment_predicate(segment: Segment) -> Column:
    return F.lit(True) if segment is None else segment.predicate()


def in_segment(df: DataFrame, segment: Segment) -> DataFrame:
    return df if segment is None else df.where(segment.predicate())


def in_any(segments: list[Segment]) -> Column:
    return reduce(Column.__or__, [segment_predicate(s) for s in segments])


def complement(df: DataFrame, segments: list[Segment]) -> DataFrame:
    """Rows that no segment takes."""
    return df.where(~in_any(segments))


def prefilter_segments(ranges: list[str]) -> list[SubnetSegment]:
    """One both-way segment per configured range."""
    return [SubnetSegment(source=r, bidir=True) for r in ranges]


def subnet_share(flows: DataFrame, ranges: dict[str, float], column: str = "src_ip", tolerance: float = 0.01) -> DataFrame:
    """Share of flows per configured range against the expected share.

    The ranges are parameters; each row finds its range by a CASE over BETWEEN tests, so nothing is joined.
    """
    total_of = {r: len(network_bounds(r)[0]) for r in ranges}
    label = F.coalesce(*[F.when(ip_in(F.col(column), r), F.lit(r)) for r in ranges], F.lit("none"))
    wanted = F.create_map(*[F.lit(x) for item in ranges.items() for x in item])
    widths = F.create_map(*[F.lit(x) for item in total_of.items() for x in item])
    counts = flows.groupBy(label.alias("range"), F.length(column).alias("width")).agg(F.count("*").alias("flows"))
    per_version = counts.groupBy("width").agg(F.sum("flows").alias("total"))
    return (
        counts.join(per_version, "width")
        .where((F.col("range") != "none") & (widths[F.col("range")] == F.col("width")))
        .select(
            "range", "flows",
            (F.col("flows") / F.col("total")).alias("share"),
            wanted[F.col("range")].alias("expected"),
        )
        .withColumn("passed", F.abs(F.col("share") - F.col("expected")) <= tolerance)
    )
