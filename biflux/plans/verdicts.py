"""Whole test verdicts composed from the operators."""

from pyspark.sql import DataFrame, functions as F

from biflux.operators import compare, mapping, replicate, segments, validate
from biflux.operators.compare import Metric, Rule, RunStats
from biflux.operators.segments import Segment


def simulation_verdict(
    reference: DataFrame,
    flows: DataFrame,
    config: dict,
    loops: int,
    stats: RunStats,
    metrics: list[Metric],
    speed: float = 1.0,
    prefilter: list[str] | None = None,
    precise: bool = False,
    active_timeout: int = 300,
    biflow_export: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Replicated reference against the exported flows: statistical result and, if asked for, the precise one.

    With a prefilter the ranges are the segments and nothing may be exported outside of them.
    """
    expected = replicate.replicate_reference(reference, config, loops, speed=speed)
    chosen: list[Segment] = segments.prefilter_segments(prefilter) if prefilter else [None]
    found, wanted = compare.prepare(flows, expected, stats, merge=precise, biflows_ts_correction=precise and biflow_export, check_unique=precise)
    result = compare.stat_compare(found, wanted, [Rule(metrics, s) for s in chosen], stats, check_complement=bool(prefilter))
    if not precise:
        return result, None
    detail = compare.precise_compare(found, wanted, active_timeout, segments=chosen, check_complement=bool(prefilter))
    return result, compare.precise_summary(detail)


def overload_verdict(
    reference: DataFrame, flows: DataFrame, config: dict, evaluated: list[Segment], stats: RunStats, metrics: list[Metric],
) -> DataFrame:
    """Three loops, the second overloads the probe and is ignored; the others are compared per segment."""
    expected = replicate.replicate_reference(reference, config, 3, ignore_loops=[1])
    found, wanted = compare.prepare(flows, expected, stats)
    return compare.stat_compare(found, wanted, [Rule(metrics, s) for s in evaluated], stats)


def validation_verdict(
    records: DataFrame, annotations: DataFrame, table: dict[str, mapping.Target], checks: validate.Checks, known: dict,
) -> tuple[DataFrame, DataFrame]:
    """Collector records (``unit_id, record``) against annotations (``ref_id, fields`` and optional
    ``forward``, ``reverse`` sections): results and unmapped keys."""
    dictionary = checks.dictionary
    mapped = mapping.map_fields(records, table, known)
    flows = mapping.direction_records(mapping.normalize(mapped, dictionary), dictionary)
    refs = mapping.direction_records(mapping.normalize_annotations(annotations, dictionary), dictionary)
    keyed_flows, keyless = mapping.with_keys(flows, dictionary, checks.key)
    keyed_refs, _ = mapping.with_keys(refs, dictionary, checks.key)
    result = validate.validate(keyed_flows, keyed_refs, checks)
    lost = keyless.select("unit_id", F.lit(None).cast("long").alias("ref_id"), F.lit(0).alias("dir"),
                          F.lit("unexpected").alias("outcome"), F.lit(None).cast(result.schema["fields"].dataType).alias("fields"))
    return result.unionByName(lost), mapping.unmapped_summary(mapped)
