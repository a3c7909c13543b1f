"""Replication of a reference flow table over replay loops and replication units."""

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from biflux.functions.ip import ip_add
from biflux.schemas import FLOW_KEY, UNIFLOW_COLUMNS, FlowDataError
from biflux.skew import global_scan, heavy_keys, keyed_scan

_PIECE_ROWS = 1_000_000


def parse_modifier(text: str | None) -> int:
    """``None``, ``addConstant(n)`` or ``addOffset(n)`` -> n."""
    if text is None or text == "None":
        return 0
    found = re.fullmatch(r"(addConstant|addOffset)\s*\(\s*(\d+)\s*\)", text.strip())
    if not found:
        raise FlowDataError(f"modifier {text!r} is not supported in a replicated reference")
    return int(found.group(2))


def parse_loop_only(value) -> frozenset[int]:
    """``All``, a number, or a list of numbers and ``"a-b"`` ranges; empty means every loop."""
    if value is None or value == "All":
        return frozenset()
    loops: set[int] = set()
    for item in [value] if isinstance(value, (int, str)) else value:
        if isinstance(item, str) and "-" in item:
            first, last = (int(x) for x in item.split("-"))
            loops.update(range(first, last + 1))
        else:
            loops.add(int(item))
    return frozenset(loops)


@dataclass(frozen=True)
class Unit:
    src: int = 0
    dst: int = 0
    loop_only: frozenset[int] = frozenset()


@dataclass(frozen=True)
class ReplicationPlan:
    units: tuple[Unit, ...]
    loop_src: int = 0
    loop_dst: int = 0
    ignore_loops: frozenset[int] = frozenset()

    @classmethod
    def from_config(cls, config: dict, ignore_loops: list[int] | None = None) -> "ReplicationPlan":
        """Read ``{"units": [{srcip, dstip, loopOnly}], "loop": {srcip, dstip}}``.

        A unit that is active in ignored loops only is skipped before its modifiers are read.
        """
        if not set(config) <= {"units", "loop"}:
            raise FlowDataError("only 'units' and 'loop' are allowed in the replication config")
        ignored = frozenset(ignore_loops or ())
        units = []
        for item in config.get("units", []):
            only = parse_loop_only(item.get("loopOnly"))
            if only and only <= ignored:
                continue
            units.append(Unit(parse_modifier(item.get("srcip")), parse_modifier(item.get("dstip")), only))
        loop = config.get("loop", {})
        return cls(tuple(units), parse_modifier(loop.get("srcip")), parse_modifier(loop.get("dstip")), ignored)

    def copies(self, loops: int) -> Counter:
        """``(loop, source offset, destination offset) -> number of units`` that produce this very copy."""
        found: Counter = Counter()
        for loop in range(loops):
            if loop in self.ignore_loops:
                continue
            for unit in self.units:
                if not unit.loop_only or loop in unit.loop_only:
                    found[(loop, loop * self.loop_src + unit.src, loop * self.loop_dst + unit.dst)] += 1
        return found


def replicate(flows: DataFrame, plan: ReplicationPlan, loops: int, speed: float = 1.0) -> DataFrame:
    """Copy every flow per loop and unit; adds ``loop``.

    Units that leave a flow with the same addresses in a loop merge with each other. All such copies come from one
    source row, so the merge is a multiplication and the whole operator is a narrow explode without any shuffle.
    """
    copies = plan.copies(loops)
    if not copies:
        raise FlowDataError("no replication unit is active in any loop")
    per = 1 / speed
    span = flows.agg(F.struct(F.min("start_time").alias("first"), F.max("end_time").alias("last"))).scalar()
    entries = F.array(*[
        F.struct(F.lit(loop).alias("loop"), F.lit(src).cast("long").alias("src_add"),
                 F.lit(dst).cast("long").alias("dst_add"), F.lit(n).cast("long").alias("times"))
        for (loop, src, dst), n in copies.items()
    ])
    keep = [c for c in flows.columns if c not in UNIFLOW_COLUMNS]
    wide = flows.select("*", span.alias("span"), F.inline(entries))
    length = ((F.col("span.last") - F.col("span.first")) * F.lit(per)).cast("long")
    start = (
        F.col("span.first") + F.col("loop") * length
        + ((F.col("start_time") - F.col("span.first")) * F.lit(per)).cast("long")
    )
    return wide.select(
        start.alias("start_time"),
        (start + ((F.col("end_time") - F.col("start_time")) * F.lit(per)).cast("long")).alias("end_time"),
        "protocol",
        ip_add(F.col("src_ip"), F.col("src_add")).alias("src_ip"),
        ip_add(F.col("dst_ip"), F.col("dst_add")).alias("dst_ip"),
        "src_port", "dst_port",
        (F.col("packets") * F.col("times")).alias("packets"), (F.col("bytes") * F.col("times")).alias("bytes"),
        "loop", *keep,
    )


def merge_across_loops(
    replicated: DataFrame, index: str, inactive_timeout: int | None, heavy: list[Row] | None = None
) -> DataFrame:
    """Merge flows of one 5-tuple over loops, leaving a gap of at least the inactive timeout (s) open.

    Rows follow each other in loop order, then by the position in the source (``index``). Without a timeout the whole
    key merges, which is a plain aggregation.
    """
    parts = [
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
    ]
    if inactive_timeout is None or inactive_timeout <= 0:
        return replicated.groupBy(*FLOW_KEY).agg(*parts).select(*UNIFLOW_COLUMNS)
    order = ["loop", index]
    piece = {"piece_loop": F.col("loop"), "piece_no": F.floor(F.col(index) / _PIECE_ROWS)}
    base = replicated.select(*UNIFLOW_COLUMNS, *order)
    heavy = heavy_keys(base, FLOW_KEY) if heavy is None else heavy  # searched once for both scans
    marked = keyed_scan(base, FLOW_KEY, order, piece, lag={"previous_end": F.col("end_time")}, heavy=heavy)
    opens = F.coalesce(F.col("start_time") - F.col("previous_end") >= inactive_timeout * 1000, F.lit(False))
    marked = marked.withColumn("opens", opens.cast("int"))
    numbered = keyed_scan(marked, FLOW_KEY, order, piece, total={"before": F.col("opens")}, heavy=heavy)
    island = (F.col("before") + F.col("opens")).alias("island")
    return numbered.groupBy(*FLOW_KEY, island).agg(*parts).select(*UNIFLOW_COLUMNS)


def replicate_reference(
    flows: DataFrame,
    config: dict,
    loops: int,
    merge: bool = False,
    inactive_timeout: int | None = None,
    speed: float = 1.0,
    ignore_loops: list[int] | None = None,
    index: str | None = None,
) -> DataFrame:
    """Config in, expected uniflow table out. ``index`` is the position of a source row, which ``merge`` follows.

    Without one, rows are numbered in the order of all their columns, so the result does not depend on partitions or
    retries; readers give the position in the files as ``arrival_seq``.
    """
    plan = ReplicationPlan.from_config(config, ignore_loops)
    if merge and index is None:
        flows, index = global_scan(flows.select(*UNIFLOW_COLUMNS), UNIFLOW_COLUMNS, total={"_index": F.lit(1).cast("long")}), "_index"
    copied = replicate(flows, plan, loops, speed)
    if merge:
        return merge_across_loops(copied, index, inactive_timeout)
    return copied.select(*UNIFLOW_COLUMNS)
