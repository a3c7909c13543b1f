"""Small operators around test scenarios: defaults, requirements, known failures, thresholds, derived segments."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from biflux.functions.ip import ip_add, net_add_offset
from biflux.operators.segments import SubnetSegment
from biflux.schemas import FlowDataError


def replay_speed(scenarios: DataFrame) -> DataFrame:
    """Speed of a test: its own mbps, pps or multiplier, else the default's in the same order, else multiplier 1.

    Columns ``mbps, pps, speed_multiplier`` and the same with ``default_``; adds ``speed_kind, speed``.
    """
    order = [("mbps", "mbps"), ("pps", "pps"), ("speed_multiplier", "multiplier")]
    kind, speed = F.lit("multiplier"), F.lit(1.0)
    for prefix in ("default_", ""):
        for name, label in reversed(order):
            column = F.col(prefix + name)
            kind = F.when(column.isNotNull(), label).otherwise(kind)
            speed = F.when(column.isNotNull(), column.cast("double")).otherwise(speed)
    return scenarios.withColumns({"speed_kind": kind, "speed": speed})


def replication_units(scenarios: DataFrame) -> DataFrame:
    """Units: given, or as many as the sampling rate of the profile left out."""
    return scenarios.withColumn("units", F.coalesce(F.col("replicator").cast("int"), (1 / F.col("sampling")).cast("int")))


def runnable(scenarios: DataFrame, protocols: Iterable[str], speed: float) -> DataFrame:
    """Scenarios whose required protocols the probe has and whose required speed the link reaches."""
    have = F.array(*[F.lit(p) for p in protocols]).cast("array<string>")
    return scenarios.where((F.size(F.array_except("protocols", have)) == 0) & (F.col("required_speed") <= speed))


def known_failures(lists: list[dict], name: str) -> list[tuple[str, str, str | None]]:
    """``(group, test, reason)`` of a list of known failures with everything it includes; own entries win.

    ``lists``: ``{"name", "include"?, "items"?: {group: [test | {test: reason}]}}``
    """
    by_name = {item["name"]: item for item in lists}
    chain: list[str] = []
    while name is not None:
        if name not in by_name:
            raise FlowDataError(f"list of known failures {name!r} not found")
        if name in chain:
            raise FlowDataError(f"circular dependency in list of known failures {name!r}")
        chain.append(name)
        name = by_name[name].get("include")
    found: dict[tuple[str, str], str | None] = {}
    for member in reversed(chain):
        for group, items in (by_name[member].get("items") or {}).items():
            for item in items:
                test, reason = next(iter(item.items())) if isinstance(item, dict) else (item, None)
                found[group, test] = reason
    return [(group, test, reason) for (group, test), reason in found.items()]


def suppress_known(results: DataFrame, failures: list[tuple[str, str, str | None]]) -> DataFrame:
    """Mark results of known failures: ``expected_failure, reason, verdict`` (passed, failed, xfailed, xpassed)."""
    table = results.sparkSession.createDataFrame(failures, "grp string, test string, reason string")
    # The list is a hand-written parameter.
    joined = results.join(F.broadcast(table.withColumn("expected_failure", F.lit(True))), ["grp", "test"], "left")
    expected = F.coalesce("expected_failure", F.lit(False))
    verdict = (
        F.when(expected & F.col("passed"), "xpassed").when(expected, "xfailed").when(F.col("passed"), "passed").otherwise("failed"))
    return joined.withColumns({"expected_failure": expected, "verdict": verdict})


def throughput_threshold(runs: DataFrame, speed_min: int, required: int, by: list[str] | None = None) -> DataFrame:
    """Highest passing speed below the lowest failing one (``speed, passed`` per run) and whether it suffices."""
    by = by or []
    lowest = F.min(F.when(~F.col("passed"), F.col("speed")))
    if by:
        runs = runs.join(runs.groupBy(*by).agg(lowest.alias("fails_at")), by)
    else:
        runs = runs.withColumn("fails_at", runs.agg(lowest).scalar())
    below = F.col("passed") & (F.col("fails_at").isNull() | (F.col("speed") < F.col("fails_at")))
    best = runs.groupBy(*by).agg(F.max("fails_at").alias("fails_at"), F.max(F.when(below, F.col("speed"))).alias("speed"))
    reached = F.greatest(F.coalesce("speed", F.lit(speed_min)), F.lit(speed_min))
    return best.select(*by, "fails_at", reached.alias("speed"), (reached >= required).alias("passed"))


def bisection_step(speed_min: int, speed_max: int, accuracy: int) -> int | None:
    """Next speed to try, rounded up to the accuracy; None when the interval is narrow enough."""
    if speed_max - speed_min <= accuracy:
        return None
    middle = (speed_max + speed_min) // 2
    return middle + (-middle) % accuracy


def overload_segments(ipv4_range: str, ipv6_range: str, prefix: int, units: int, loop_step: int) -> list[SubnetSegment]:
    """One segment per unit and IP version for the first and the third loop of an overload run."""
    v4, v6 = (f"{r.split('/')[0]}" for r in (ipv4_range, ipv6_range))
    shift = 1 << (32 - prefix)
    segments = []
    for loop in (0, 2):
        for unit in range(units):
            offset = (unit + loop * loop_step) * shift
            for base, width in ((v4, 32), (v6, 128)):
                net = net_add_offset(f"{base}/{width}", offset).split("/")[0]
                segments.append(SubnetSegment(f"{net}/{prefix}", f"{net}/{prefix}"))
    return segments


def extended_ranges(ranges: list[str], unit_offsets: list[int], loop_offset: int, loops: int) -> list[str]:
    """Prefilter ranges moved with every unit and loop, without repeats."""
    return sorted({net_add_offset(net_add_offset(r, u), loop * loop_offset)
                   for r in ranges for u in unit_offsets for loop in range(loops)})


def extended_range_table(ranges: DataFrame, unit_offsets: list[int], loop_offset: int, loops: int) -> DataFrame:
    """The same for a table of ranges in canonical hex (``low, high``)."""
    offsets = F.array(*[F.lit(u + loop * loop_offset) for u in unit_offsets for loop in range(loops)])
    moved = ranges.withColumn("offset", F.explode(offsets))
    return moved.select(*[ip_add(F.col(c), F.col("offset").cast("long")).alias(c) for c in ("low", "high")]).distinct()
