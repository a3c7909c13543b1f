"""A stream in arrival order gives the batch profile."""

import pyarrow as pa
import pytest

from biflux.operators.profile_build import build_profile
from biflux.streaming.cache import close_profile_stream, limited_open_flows, run_limited_stream, run_profile_stream
from biflux.streaming import meter
from biflux.streaming.closing import drain
from tests.test_profile_build import ACTIVE, INACTIVE, frame, records


def test_stream_equals_batch(spark, tmp_path):
    rows = [{**r, "start_time": r["start_time"] + 10**9, "end_time": r["end_time"] + 10**9} for r in records(11, 1200, 3, 5_000)]
    # In order of their end nothing is late, and a last record long after the others moves the watermark past all flows.
    rows.sort(key=lambda r: r["end_time"])
    rows = [{**r, "arrival_seq": i} for i, r in enumerate(rows)]
    source = tmp_path / "in"
    for at in range(0, len(rows), 300):
        frame(spark, rows[at:at + 300]).coalesce(1).write.mode("append").parquet(str(source))
    last = {**rows[0], "arrival_seq": 10**6, "start_time": 2 * 10**9, "end_time": 2 * 10**9, "dst_ip": "10.9.9.9", "src_ip": "10.9.9.8"}
    schema = frame(spark, rows[:1]).schema
    for step in (None, last):
        if step:
            frame(spark, [step]).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
        run_profile_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in build_profile(frame(spark, rows)).collect())
    assert got == want


def stream_of(spark, source, rows=None):
    schema = frame(spark, records(1, 1, 1, 10)).schema
    return spark.readStream.schema(schema).parquet(str(source))


def test_closed_stream_is_the_batch_profile_and_counts_late_rows(spark, tmp_path):
    rows = sorted(({**r, "start_time": r["start_time"] + 10**9, "end_time": r["end_time"] + 10**9} for r in records(12, 900, 3, 5_000)), key=lambda r: r["end_time"])
    rows = [{**r, "arrival_seq": i} for i, r in enumerate(rows)]
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    frame(spark, rows[:500]).write.mode("append").parquet(str(source))
    first, late = close_profile_stream(stream_of(spark, source), out, state)
    assert late == 0 and sorted(map(tuple, first.collect())) == sorted(map(tuple, build_profile(frame(spark, rows[:500])).collect()))
    # The stream goes on where it was; rows from long ago are dropped and counted.
    old = [{**r, "start_time": r["start_time"] - 10**8, "end_time": r["end_time"] - 10**8, "arrival_seq": 10**6 + i} for i, r in enumerate(rows[:37])]
    frame(spark, rows[500:] + old).write.mode("append").parquet(str(source))
    whole, late = close_profile_stream(stream_of(spark, source), out, state)
    assert late == 37
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, build_profile(frame(spark, rows)).collect()))


def limited(rows, limit):
    """One sequential cache that looks for old flows only when it is full."""
    cache, done, now = {}, [], 0

    def out(key, f):
        done.append((f["s"], f["e"], f["l3"], key[4], *((key[3], key[2]) if f["swap"] else (key[2], key[3])), f["p"], f["b"], f["pr"], f["br"]))

    for r in rows:
        sp, dp = (r["src_port"], r["dst_port"]) if r["proto"] in (6, 17) else (0, 0)
        swap = r["src_ip"] > r["dst_ip"]
        key = (r["dst_ip"], r["src_ip"], dp, sp, r["proto"]) if swap else (r["src_ip"], r["dst_ip"], sp, dp, r["proto"])
        now = max(now, r["end_time"])
        fresh = {"s": r["start_time"], "e": r["end_time"], "swap": swap, "p": r["packets"], "b": r["bytes"], "pr": 0, "br": 0, "l3": 4}
        f = cache.get(key)
        if f is None:
            cache[key] = fresh
            if len(cache) >= limit:
                old = [k for k, v in cache.items() if v["e"] < now - 1.5 * ACTIVE]
                if not old:
                    return None
                for k in old:
                    out(k, cache.pop(k))
            continue
        gap = f["e"] + INACTIVE < r["start_time"]
        if ((f["pr"] == 0 and swap != f["swap"] and not gap and r["end_time"] + INACTIVE >= f["s"])
                or (r["packets"] == 1 and abs(r["start_time"] - f["e"]) < INACTIVE) or (f["e"] - f["s"] >= ACTIVE - INACTIVE and not gap)):
            f["s"], f["e"] = min(f["s"], r["start_time"]), max(f["e"], r["end_time"])
            p, b = ("p", "b") if swap == f["swap"] else ("pr", "br")
            f[p] += r["packets"]
            f[b] += r["bytes"]
        else:
            out(key, f)
            cache[key] = fresh
    for key, f in cache.items():
        out(key, f)
    return sorted(done)


def test_cache_with_a_size_limit(spark, tmp_path):
    rows = records(21, 700, 12, 20_000)
    source = tmp_path / "in"
    for at in (0, 350):
        frame(spark, rows[at:at + 350]).coalesce(1).write.mode("append").parquet(str(source))
    full = sorted(map(tuple, build_profile(frame(spark, rows)).collect()))
    seen = []
    for limit in (10_000, 40, 30):
        want = limited(rows, limit)
        out, state = str(tmp_path / f"out-{limit}"), str(tmp_path / f"state-{limit}")
        stream = spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        drain(run_limited_stream(stream, out, state, limit))
        found = spark.read.parquet(out).unionByName(limited_open_flows(spark, state))
        assert sorted(map(tuple, found.collect())) == want
        seen.append(want == full)
    assert seen[0]
    assert limited(rows, 5) is None
    stream = stream_of(spark, source)
    with pytest.raises(Exception, match="full of flows"):
        drain(run_limited_stream(stream, str(tmp_path / "o"), str(tmp_path / "s"), 5))


@pytest.mark.parametrize("piece", [7, 131_072])
def test_flows_are_summed_per_second_before_the_stream_state(spark, tmp_path, monkeypatch, piece):
    """A row per second and batch reaches the watermark, not one per flow and second."""
    monkeypatch.setattr(meter, "LAID_OUT", piece)
    rows = [(1000 * (k % 5), 1000 * (k % 5 + k % 40), k, 40 * k, None if k % 9 == 0 else 1, 3) for k in range(400)]
    rows += [(None, 5000, 1, 1, 1, 1), (5000, None, 1, 1, 1, 1), (9000, 5000, 6, 6, 0, 0), (70_000, 70_000, None, 5, 1, 0), (10**8, 10**8 + 500, 2, 2, 0, 0)]
    schema = "start_time long, end_time long, packets long, bytes long, packets_rev long, bytes_rev long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {}
    for s, e, p, b, pr, br in rows:
        if s is None or e is None:
            continue
        first, last = s // 1000, e // 1000
        for second in range(first, last + 1) if first <= last else range(first, last - 1, -1):
            at = want.setdefault(second, [None, None, 0])
            if p is not None and pr is not None:
                at[0] = (at[0] or 0) + (p + pr) / (last - first + 1)
            at[1] = (at[1] or 0) + (b + br) * 8 / (last - first + 1)
            at[2] += second == first
    if piece > 7:
        stream = meter.stream_timeline(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        seen = drain(stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        assert sum(b["late"] for b in seen.values()) == 0
        made = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).unionByName(meter.open_seconds(spark, str(tmp_path / "state"))).collect()
        found = {r.second: [r.packets, r.bits, r.starts] for r in made}
    else:
        found = {}
        spans = [(s // 1000, e // 1000, None if p is None or pr is None else (p + pr) / (e // 1000 - s // 1000 + 1), (b + br) * 8 / (e // 1000 - s // 1000 + 1))
                 for s, e, p, b, pr, br in rows if s is not None and e is not None]
        batch = pa.RecordBatch.from_pylist([dict(zip(("first", "last", "packets", "bits"), r)) for r in spans])
        for r in (r for made in meter._per_second(iter([batch])) for r in made.to_pylist()):
            at = found.setdefault(r["second"], [None, None, 0])
            for k, c in enumerate(("packets", "bits")):
                at[k] = at[k] if r[c] is None else (at[k] or 0) + r[c]
            at[2] += r["starts"]
    assert found.keys() == want.keys()
    for second, values in want.items():
        assert found[second] == [None if v is None else pytest.approx(v) for v in values]
