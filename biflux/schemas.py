"""Column layouts of the table kinds the package works on."""

from pyspark.sql import types as T

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


def _struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in spec])


UNIFLOW = _struct([
    ("start_time", L), ("end_time", L), ("protocol", I), ("src_ip", S), ("dst_ip", S),
    ("src_port", I), ("dst_port", I), ("packets", L), ("bytes", L),
])
PROFILE = _struct([
    ("start_time", L), ("end_time", L), ("l3_proto", I), ("l4_proto", I), ("src_port", I), ("dst_port", I),
    ("packets", L), ("bytes", L), ("packets_rev", L), ("bytes_rev", L),
])
PROFILE_IPS = T.StructType(PROFILE.fields + _struct([("src_ip", S), ("dst_ip", S)]).fields)
REPORT = _struct([
    ("src_ip", S), ("dst_ip", S), ("start_time", D), ("end_time", D), ("start_time_rev", D), ("end_time_rev", D),
    ("l3_proto", I), ("l4_proto", I), ("src_port", I), ("dst_port", I),
    ("packets", L), ("bytes", L), ("packets_rev", L), ("bytes_rev", L),
])
RAWFLOW = _struct([
    ("start_time", D), ("duration", D), ("proto", I), ("src_ip", S), ("dst_ip", S), ("src_port", I), ("dst_port", I),
    ("packets", L), ("bytes", L),
])

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
UNIFLOW_COLUMNS = [f.name for f in UNIFLOW.fields]
PROFILE_COLUMNS = [f.name for f in PROFILE.fields]
REPORT_COLUMNS = [f.name for f in REPORT.fields]


class FlowDataError(Exception):
    """A table or a parameter that the operators cannot work with."""
