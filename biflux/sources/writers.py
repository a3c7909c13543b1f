"""Writers for profile, uniflow and report CSV."""

from pyspark.sql import DataFrame, Observation, functions as F

from biflux.functions.ip import ip_format
from biflux.schemas import PROFILE_COLUMNS, REPORT_COLUMNS, UNIFLOW_COLUMNS


def _write(df: DataFrame, path: str, gzip: bool) -> int:
    counted = Observation()
    upper = df.observe(counted, F.count(F.lit(1)).alias("rows")).toDF(*[c.upper() for c in df.columns])
    upper.write.mode("errorifexists").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)
    return counted.get["rows"]


def write_profile(profile: DataFrame, path: str, gzip: bool = False) -> int:
    """Profile CSV with the fixed header, addresses last if there are any; returns the number of rows."""
    extra = [ip_format(F.col(c)).alias(c) for c in ("src_ip", "dst_ip") if c in profile.columns]
    return _write(profile.select(*PROFILE_COLUMNS, *extra), path, gzip)


def write_uniflow(flows: DataFrame, path: str, gzip: bool = False) -> int:
    """Uniflow CSV with addresses as text."""
    columns = [ip_format(F.col(c)).alias(c) if c.endswith("_ip") else F.col(c) for c in UNIFLOW_COLUMNS]
    return _write(flows.select(*columns), path, gzip)


def write_report(report: DataFrame, path: str, gzip: bool = False) -> int:
    """Generator report CSV; times keep their fraction of a millisecond."""
    columns = [ip_format(F.col(c)).alias(c) if c.endswith("_ip") else F.col(c) for c in REPORT_COLUMNS]
    return _write(report.select(*columns), path, gzip)

