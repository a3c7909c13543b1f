import pytest
from pyspark.sql import functions as F

from biflux.functions.ip import ip_add, ip_format, ip_in, ip_parse, net_add_offset, replicator_prefix
from biflux.operators.biflow import split_biflows
from biflux.operators.profile_build import build_profile, to_ms
from biflux.schemas import FlowDataError
from biflux.sources import readers, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_uniflow_round_trip(spark, tmp_path):
    source = write(tmp_path / "f.csv", "START_TIME,END_TIME,PROTOCOL,SRC_IP,DST_IP,SRC_PORT,DST_PORT,PACKETS,BYTES\n"
                   "1,2,1,10.0.0.1,2001:DB8:0:0::1,,,3,4\n5,6,6,::ffff:1.2.3.4,8.8.8.8,1,2,3,4\n")
    flows = readers.read_uniflow(spark, source)
    assert flows.orderBy("start_time").first()[2:7] == (1, "0a000001", "20010db8000000000000000000000001", 0, 0)
    assert writers.write_uniflow(flows, str(tmp_path / "out"), gzip=True) == 2
    assert sorted(readers.read_uniflow(spark, str(tmp_path / "out")).collect()) == sorted(flows.collect())
    assert readers.read_uniflow(spark, source, where="protocol = 6", limit=1).count() == 1


def test_malformed_uniflow(spark, tmp_path):
    with pytest.raises(FlowDataError):
        readers.read_uniflow(spark, write(tmp_path / "f.csv", "not,a,flow\n"))
    with pytest.raises(FlowDataError):
        readers.as_uniflow(spark, spark.range(1))


def test_profile_header_order_comments_and_rejects(spark, tmp_path):
    source = write(tmp_path / "p.csv", "# comment\n\nEND_TIME, START_TIME,L3_PROTO,L4_PROTO,SRC_PORT,DST_PORT,PACKETS,BYTES,PACKETS_REV,BYTES_REV\n"
                   "9,-3,4,6, 1,2,1,60,0,0\n# again\n9,10,4,6,1,2,1,60,0,0\n9,1,4,47,1,2,1,60,0,0\n9,1,4,1,7,,1,60,0,0\n")
    parsed = readers.read_profile(spark, source, skip_unknown=True)
    assert sorted(tuple(r) for r in parsed.rows.collect()) == [(-3, 9, 4, 6, 1, 2, 1, 60, 0, 0), (1, 9, 4, 1, 0, 0, 1, 60, 0, 0)]
    assert sorted((r.error, r.skipped) for r in parsed.rejected.collect()) == [
        ("end_time: before the start", False), ("l4_proto: not supported", True)]
    with pytest.raises(FlowDataError):
        readers.parse_profile(parsed.rejected.select("value"), ["START_TIME"])


def test_raw_flows_in_file_order(spark, tmp_path):
    head = "START_TIME,DURATION,PROTO,SRC_IP,DST_IP,SRC_PORT,DST_PORT,PACKETS,BYTES\n"
    for name, base in (("a.csv", 0), ("b.csv", 100)):
        write(tmp_path / name, head + "# note\n" + "".join(f"{base + i}.5,0.25,6,1.1.1.1,2.2.2.2,1,2,3,4\n" for i in range(100)) + "x,1,6,1.1.1.1,2.2.2.2,1,2,3,4\n")
    parsed = readers.read_rawflow(spark, str(tmp_path))
    starts = [r.start_time for r in parsed.rows.orderBy("arrival_seq").collect()]
    assert starts == [i + 0.5 for i in range(200)] and parsed.rejected.count() == 2
    times = to_ms(parsed.rows).orderBy("arrival_seq").select("start_time", "end_time").head(2)
    assert [tuple(t) for t in times] == [(0, 250), (1000, 1250)]
    assert build_profile(to_ms(parsed.rows)).agg(F.sum("packets")).first()[0] == 600


def test_report_split(spark):
    row = ("0a000001", "0a000002", 1.75, 9.25, 0.0, 0.0, 4, 17, 5, 6, 2, 100, 0, 0)
    both = ("0a000001", "0a000003", 1.75, 9.25, 0.5, 12.9, 4, 17, 5, 6, 2, 100, 1, 60)
    from biflux.schemas import REPORT
    result = split_biflows(spark.createDataFrame([row, both], REPORT), biflow_export=True).collect()
    assert sorted((r.src_ip[-1], r.dst_ip[-1], r.start_time, r.end_time, r.packets) for r in result) == [
        ("1", "2", 1, 9, 2), ("1", "3", 0, 12, 2), ("3", "1", 0, 12, 1)]


def test_run_logs(spark, tmp_path):
    write(tmp_path / "run.log", "Actual: 5 packets (9 bytes)\nActual: 7 packets (11 bytes) sent\nStart time: x [ms since epoch: 3]\nEnd time: y [ms since epoch: 8]\n")
    assert tuple(readers.read_run_logs(spark, str(tmp_path)).first())[1:] == (7, 11, 3, 8)


def test_address_helpers(spark):
    row = spark.range(1).select(
        ip_add(F.lit("ffffffff"), 2).alias("a"), ip_add(F.lit("f" * 32), 1).alias("b"), ip_in(ip_parse(F.lit("fe80::1")), "fe80::/10").alias("c"),
        ip_format(F.lit("20010db8000000000001000000000001")).alias("d")).first()
    assert tuple(row) == ("00000001", "00000000" + "f" * 24, True, "2001:db8::1:0:0:1")
    assert net_add_offset("10.0.0.0/8", 1 << 24) == "11.0.0.0/8" and net_add_offset("10.0.0.0/8", 1) == "10.0.0.0/8"
    assert replicator_prefix(4, 8, "10.0.0.0/16 50%", None) == 8 and replicator_prefix(4, 8, ["10.0.0.0/6"]) == 4


def test_cells_are_taken_once(spark, tmp_path):
    """cells of a line were looked up and parsed again for every check on them."""
    uniflow, profile = tmp_path / "uniflow.csv", tmp_path / "profile.csv"
    names = [f.name.upper() for f in readers.UNIFLOW.fields]
    uniflow.write_text(",".join(names) + "\n" + ",".join("10.0.0.1" if n.endswith("_IP") else "6" for n in names) + "\n")
    profile.write_text(",".join(readers.PROFILE_HEADER) + "\n" + ",".join({"L3_PROTO": "4"}.get(n, "6") for n in readers.PROFILE_HEADER) + "\n")
    for rows, columns in ((readers.read_uniflow(spark, str(uniflow)), names), (readers.read_profile(spark, str(profile)).rows, readers.PROFILE_HEADER)):
        assert rows.count() == 1
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_position") <= 2 * len(columns), plan.count("array_position")
