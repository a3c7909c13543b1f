"""Biflow records: split into directions, move in time, check against disk space."""

from pyspark.sql import DataFrame, functions as F

from biflux.functions.scalars import disk_size
from biflux.schemas import FLOW_KEY


def split_biflows(report: DataFrame, biflow_export: bool = False) -> DataFrame:
    """Generator report -> uniflows, one scan: forward and reverse row of each biflow, empty directions dropped.

    With ``biflow_export`` both directions get the common start and end. The times of an absent direction are zero in
    the report and take no part. Fractional milliseconds are cut.
    """
    names = ["src_ip", "dst_ip", "src_port", "dst_port", "start_time", "end_time", "packets", "bytes",
             "o_start", "o_end", "o_packets"]
    forward = ["src_ip", "dst_ip", "src_port", "dst_port", "start_time", "end_time", "packets", "bytes",
               "start_time_rev", "end_time_rev", "packets_rev"]
    reverse = ["dst_ip", "src_ip", "dst_port", "src_port", "start_time_rev", "end_time_rev", "packets_rev", "bytes_rev",
               "start_time", "end_time", "packets"]
    sides = [F.struct(*[F.col(c).alias(n) for n, c in zip(names, cols)]) for cols in (forward, reverse)]
    rows = report.select(F.col("l4_proto").alias("protocol"), F.inline(F.array(*sides))).where(F.col("packets") > 0)
    start, end = F.col("start_time"), F.col("end_time")
    if biflow_export:
        paired = F.col("o_packets") > 0
        start = F.when(paired, F.least(start, F.col("o_start"))).otherwise(start)
        end = F.when(paired, F.greatest(end, F.col("o_end"))).otherwise(end)
    return rows.select(
        start.cast("long").alias("start_time"), end.cast("long").alias("end_time"),
        F.col("protocol").cast("int").alias("protocol"),
        *[c for c in FLOW_KEY if c != "protocol"], "packets", "bytes",
    )


def rebase_to_minimum(df: DataFrame) -> DataFrame:
    """Move times so that the earliest start is zero."""
    first = df.agg(F.min("start_time")).scalar()
    return df.withColumns({c: F.col(c) - first for c in ("start_time", "end_time")})


def capacity_check(profile: DataFrame, available: int) -> DataFrame:
    """Estimated size of the whole capture against the free space."""
    size = disk_size(F.col("packets") + F.col("packets_rev"), F.col("bytes") + F.col("bytes_rev"))
    return profile.agg(F.sum(size).alias("expected_size")).select(
        "expected_size", F.lit(available).cast("long").alias("available"),
        (F.col("expected_size") <= available).alias("fits"),
    )
