"""Registered queries that write the test tables as text files and read them back."""

import os

from pyspark.sql import functions as F

from biflux.functions.ip import ip_format, ip_parse
from biflux.operators import profile_build
from biflux.plans import profile_queries as pq, validation_queries as vq
from biflux.plans.views import cte, view
from biflux.runtime import shared_folder
from biflux.schemas import PROFILE_COLUMNS, RAWFLOW, REPORT, REPORT_COLUMNS, UNIFLOW_COLUMNS
from biflux.sources import readers, writers


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{os.urandom(8).hex()}"


def _write_lines(rows, columns, path, note="true"):
    """CSV files with the columns in the given order under a header of their own; rows with ``note`` follow a comment line."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = rows.select(F.inline(F.when(F.expr(note), F.array(F.struct(F.lit("# note, with a comma").alias("value")), F.struct(line.alias("value")))).otherwise(
        F.array(F.struct(line.alias("value"))))))
    # Separator and comment signs that do not occur keep the header line and the lines as they are.
    lines.toDF(", ".join(c.upper() for c in columns)).write.option("header", True).option("sep", "\x01").option("quote", "").option("comment", "\x02").csv(path)


def _uniflow_files(spark, sf_dir):
    """Three folders with other orders of columns, one with a column more, in names with a plus, a blank and a percent sign."""
    flows = view(spark, sf_dir, "ref_flows").withColumns({c: ip_format(F.col(c)) for c in ("src_ip", "dst_ip")})
    flows = flows.withColumns({"src_port": F.when(F.col("src_port") % 3 > 0, F.col("src_port")), "extra": F.lit("x")})
    path = _folder(spark, "uniflow")
    for k, (name, columns) in enumerate([
            ("a +b", UNIFLOW_COLUMNS), ("c%20 d", [*reversed(UNIFLOW_COLUMNS)]), ("e", ["extra", *UNIFLOW_COLUMNS[4:], *UNIFLOW_COLUMNS[:4]])]):
        _write_lines(flows.where(F.col("packets") % 3 == k), columns, f"{path}/{name}", "packets % 5 = 0")
    return readers.read(spark, "uniflow", f"{path}/*")


def _rawflow_files(spark, sf_dir):
    """The profile of raw flows read from two folders of files in arrival order, with other headers and broken lines."""
    raw = view(spark, sf_dir, "raw_flows").orderBy("arrival_seq")
    half = raw.count() // 2
    names, path = [f.name for f in RAWFLOW.fields], _folder(spark, "raw flow+")
    broken = raw.withColumn("packets", F.when(F.col("arrival_seq") % 2 == 0, F.lit("many")).otherwise(F.col("packets").cast("string")))
    for k, columns in enumerate((names, [*names[5:], "arrival_seq", *names[:5]])):
        part = raw.where((F.col("arrival_seq") >= half) == bool(k))
        both = part.withColumn("packets", F.col("packets").cast("string")).withColumn("copy", F.lit(1)).unionByName(
            broken.where(((F.col("arrival_seq") >= half) == bool(k)) & (F.col("arrival_seq") % 100 == 0)).withColumn("copy", F.lit(0)))
        _write_lines(both.orderBy("arrival_seq", "copy"), columns, f"{path}/{k} +", "arrival_seq % 7 = 0")
    parsed = readers.read(spark, "csv", f"{path}/*")
    return profile_build.build_profile(profile_build.to_ms(parsed.rows))


def _profile_files(spark, sf_dir):
    """A written profile, addresses included, and one without them in another order; counters beyond 63 bits."""
    profile = view(spark, sf_dir, "profile")
    path = _folder(spark, "profile")
    writers.write_profile(profile.where("flow_id % 2 = 0").select(*PROFILE_COLUMNS, "src_ip", "dst_ip"), f"{path}/1", gzip=True)
    large = profile.where("flow_id % 2 = 1").withColumn("bytes", F.when(F.col("flow_id") % 9 == 0, F.lit("18446744073709551615")).otherwise(F.col("bytes").cast("string")))
    _write_lines(large, [*reversed(PROFILE_COLUMNS)], f"{path}/2", "flow_id % 4 = 1")
    rows = readers.read(spark, "profile", f"{path}/*", wide=True).rows
    return rows.groupBy("l3_proto", "l4_proto", "src_port", "dst_port", "src_ip", "dst_ip").agg(
        F.count("*").alias("flows"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.sum(F.col("packets") + F.col("packets_rev")).cast("string").alias("packets"), F.max("bytes").cast("string").alias("bytes"),
        F.sum("bytes_rev").cast("string").alias("bytes_rev"))


def _uniflow_roundtrip(spark, sf_dir):
    path = _folder(spark, "written")
    rows = writers.write_uniflow(view(spark, sf_dir, "probe_flows"), path)
    return readers.read_uniflow(spark, path).withColumn("written", F.lit(rows).cast("long"))


def _report_roundtrip(spark, sf_dir):
    """The written report, read with its own header and column types."""
    path = _folder(spark, "report")
    writers.write_report(view(spark, sf_dir, "report"), path, gzip=True)
    schema = ", ".join(f"{f.name.upper()} {'string' if f.name.endswith('_ip') else f.dataType.simpleString()}" for f in REPORT.fields)
    back = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    return back.select(*[(ip_parse(F.col(c.upper())) if c.endswith("_ip") else F.col(c.upper())).alias(c) for c in REPORT_COLUMNS])


def _json_files(spark, sf_dir):
    path = _folder(spark, "dump +")
    vq._json_lines(spark, sf_dir).select("value").write.text(path)
    return readers.read(spark, "json", path).rows.drop("arrival_seq")


def _text_files(spark, sf_dir):
    path = _folder(spark, "export %2B")
    vq._text_lines(spark, sf_dir).select("value").write.text(path)
    return readers.read(spark, "text", path, router="192.0.2.2", interface=1).rows.drop("arrival_seq")


def _numbers(spark, sf_dir):
    """Line numbers of files with few lines per block: gapless, and in the order that was written."""
    path = _folder(spark, "lines")
    view(spark, sf_dir, "raw_flows").select(F.col("arrival_seq").cast("string").alias("value")).orderBy("arrival_seq").write.text(path)
    return readers.with_arrival(spark.read.text(path)).select(F.col("value").cast("long").alias("event_id"), "arrival_seq")


QUERIES = {
    "read_uniflow_files": (_uniflow_files, cte("ref_flows") + """SELECT * REPLACE (CAST(CASE WHEN src_port % 3 > 0 THEN src_port ELSE 0 END AS INTEGER) AS src_port) FROM ref_flows"""),
    "read_rawflow_files": (_rawflow_files, pq.profile_sql()),
    "read_profile_files": (_profile_files, cte("profile", back="""SELECT flow_id, l3_proto, l4_proto, src_port, dst_port, CASE WHEN flow_id % 2 = 0 THEN src_ip END AS src_ip,
        CASE WHEN flow_id % 2 = 0 THEN dst_ip END AS dst_ip, start_time, end_time, packets + packets_rev AS p, bytes_rev,
        CASE WHEN flow_id % 18 = 9 THEN CAST(18446744073709551615 AS HUGEINT) ELSE CAST(bytes AS HUGEINT) END AS b FROM profile""") + """
        SELECT l3_proto, l4_proto, src_port, dst_port, src_ip, dst_ip, count(*) AS flows, min(start_time) AS start_time, max(end_time) AS end_time,
          CAST(sum(p) AS VARCHAR) AS packets, CAST(max(b) AS VARCHAR) AS bytes, CAST(sum(bytes_rev) AS VARCHAR) AS bytes_rev FROM back GROUP BY ALL"""),
    "write_uniflow_roundtrip": (_uniflow_roundtrip, cte("probe_flows") + "SELECT *, count(*) OVER () AS written FROM probe_flows"),
    "write_report_roundtrip": (_report_roundtrip, cte("report") + "SELECT * FROM report"),
    "read_json_files": (_json_files, vq.QUERIES["read_flow_json"][1].replace("SELECT event_id, event_id * 10", "SELECT event_id * 10", 1)),
    "read_text_files": (_text_files, vq.QUERIES["read_flow_text"][1].replace("SELECT event_id, event_id * 10", "SELECT event_id * 10", 1)),
    "line_numbers": (_numbers, "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS arrival_seq FROM events"),
}
