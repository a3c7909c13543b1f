"""Lines of files whose names have a plus or a blank are all read, in one order."""

import pytest
from pyspark.sql import functions as F

from biflux.schemas import FlowDataError
from biflux.sources import readers
from biflux.sources.readers import with_arrival


def test_plus_and_blank_in_names(spark, tmp_path):
    for name in ("a+b.csv", "a b.csv", "c.csv"):
        (tmp_path / name).write_text("1\n2\n3\n")
    lines = spark.read.text(str(tmp_path))
    got = with_arrival(lines).collect()
    assert len(got) == 9 and len({r.arrival_seq for r in got}) == 9


@pytest.mark.parametrize("size", [500, 4000, 1 << 20])
def test_numbers_do_not_depend_on_how_files_are_cut(spark, tmp_path, size):
    """Several blocks of several files in one task; the numbers are those of one pass over the files by name."""
    want = []
    for name, rows in (("b 1.txt", 700), ("a+.txt", 90), ("c.txt", 1), ("d%.txt", 300)):
        (tmp_path / name).write_text("".join(f"{name}:{k}\n" for k in range(rows)))
    for name, rows in (("a+.txt", 90), ("b 1.txt", 700), ("c.txt", 1), ("d%.txt", 300)):
        want += [f"{name}:{k}" for k in range(rows)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = with_arrival(spark.read.text(str(tmp_path)).withColumn("file", F.lit("kept"))).orderBy("arrival_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.value for r in got] == want and [r.arrival_seq for r in got] == list(range(len(want))) and got[0].file == "kept"


HEAD = "START_TIME,END_TIME,PROTOCOL,SRC_IP,DST_IP,SRC_PORT,DST_PORT,PACKETS,BYTES"


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"# first\n\n{HEAD}\n1,2,6,10.0.0.1,10.0.0.2,5,6,7,8\n")
    (tmp_path / "b +.csv").write_text("BYTES, PACKETS,note,DST_PORT,SRC_PORT,DST_IP,SRC_IP,PROTOCOL,END_TIME,START_TIME\n# c\n80,70,x,,50,10.0.0.4,10.0.0.3,17,20,10\n")
    (tmp_path / "c.csv").write_text(f"{HEAD}\n")
    rows = sorted(tuple(r) for r in readers.read_uniflow(spark, str(tmp_path)).collect())
    assert rows == [(1, 2, 6, "0a000001", "0a000002", 5, 6, 7, 8), (10, 20, 17, "0a000003", "0a000004", 50, 0, 70, 80)]
    (tmp_path / "d.csv").write_text(f"{HEAD}\n1,2,6,10.0.0.1,10.0.0.2,5,6,many,8\n")
    with pytest.raises(Exception, match="PACKETS unreadable"):
        readers.read_uniflow(spark, str(tmp_path)).collect()
    (tmp_path / "e.csv").write_text("START_TIME,END_TIME\n")
    with pytest.raises(FlowDataError, match="e.csv has no column PROTOCOL"):
        readers.read_uniflow(spark, str(tmp_path))
    (tmp_path / "e.csv").write_text("# nothing else\n")
    with pytest.raises(FlowDataError, match="has no header"):
        readers.read_uniflow(spark, str(tmp_path))
    with pytest.raises(FlowDataError, match="unable to read"):
        readers.read_uniflow(spark, str(tmp_path / "none"))
    with pytest.raises(FlowDataError, match="unknown reader"):
        readers.read(spark, "fds", str(tmp_path))


def test_profile_files_with_other_headers(spark, tmp_path):
    names = readers.PROFILE_HEADER
    (tmp_path / "a.csv").write_text(",".join(names) + "\n1,2,4,6,3,4,18446744073709551615,60,0,0\n")
    (tmp_path / "b.csv").write_text(",".join(["SRC_IP", *reversed(names)]) + "\n10.0.0.1,0,0,70,9,4,3,17,4,8,7\n,0,0,x,9,4,3,17,4,8,7\n")
    parsed = readers.read_profile(spark, str(tmp_path), wide=True)
    assert sorted((r.start_time, r.packets, r.src_ip or "") for r in parsed.rows.collect()) == [(1, 2**64 - 1, ""), (7, 9, "0a000001")]
    assert [r.error for r in parsed.rejected.collect()] == ["bytes: no number in range"]
    assert [r.error for r in readers.read_profile(spark, str(tmp_path / "a.csv")).rejected.collect()] == ["packets: no number in range"]
    (tmp_path / "c.csv").write_text(",".join([*names, "COLOUR"]) + "\n")
    with pytest.raises(FlowDataError, match="unknown column"):
        readers.read_profile(spark, str(tmp_path))
