"""The profile builder against a plain sequential run of the cache rules."""

import random

from pyspark.sql import Row

from biflux.operators.profile_build import KEY, build_profile

INACTIVE, ACTIVE = 30_000, 300_000


def sequential(records):
    """One cache, one record at a time, written independently of the package."""
    cache, done = {}, []
    for r in sorted(records, key=lambda r: r["arrival_seq"]):
        sp, dp = (r["src_port"], r["dst_port"]) if r["proto"] in (6, 17) else (0, 0)
        swap = r["src_ip"] > r["dst_ip"]
        key = (r["dst_ip"], r["src_ip"], dp, sp, r["proto"]) if swap else (r["src_ip"], r["dst_ip"], sp, dp, r["proto"])
        f = cache.get(key)
        if f is not None:
            late = f["e"] + INACTIVE < r["start_time"]
            reverse = f["pr"] == 0 and swap != f["swap"] and not late and r["end_time"] + INACTIVE >= f["s"]
            early = r["packets"] == 1 and abs(r["start_time"] - f["e"]) < INACTIVE
            extends = f["e"] - f["s"] >= ACTIVE - INACTIVE and not late
            if reverse or early or extends:
                f["s"], f["e"] = min(f["s"], r["start_time"]), max(f["e"], r["end_time"])
                p, b = ("p", "b") if swap == f["swap"] else ("pr", "br")
                f[p] += r["packets"]
                f[b] += r["bytes"]
                continue
            done.append((key, f))
        cache[key] = {"s": r["start_time"], "e": r["end_time"], "swap": swap, "p": r["packets"], "b": r["bytes"],
                      "pr": 0, "br": 0, "l3": 6 if ":" in r["src_ip"] else 4}
    done += cache.items()
    return sorted(
        (f["s"], f["e"], f["l3"], k[4], *((k[3], k[2]) if f["swap"] else (k[2], k[3])), f["p"], f["b"], f["pr"], f["br"])
        for k, f in done
    )


def records(seed, n, keys, step):
    rng = random.Random(seed)
    now, out = 0, []
    for i in range(n):
        now += rng.randrange(step)
        a, b = ("10.0.0.1", f"10.0.0.{2 + rng.randrange(keys)}") if rng.random() < 0.6 else (f"10.0.0.{2 + rng.randrange(keys)}", "10.0.0.1")
        start = now - rng.randrange(3) * rng.randrange(40_000)
        out.append({
            "arrival_seq": i, "start_time": start, "end_time": start + rng.choice([0, 10, 5000, 120_000, 290_000, 299_000]),
            "proto": rng.choice([6, 6, 17, 1]), "src_ip": a, "dst_ip": b, "src_port": 5, "dst_port": 5,
            "packets": rng.choice([0, 1, 1, 2, 7]), "bytes": rng.randrange(1000),
        })
    return out


SCHEMA = ("arrival_seq long, start_time long, end_time long, proto int, src_ip string, dst_ip string,"
          " src_port int, dst_port int, packets long, bytes long")


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_equals_sequential_fold(spark):
    for seed, step in ((1, 2_000), (2, 30_000), (3, 200)):
        rows = records(seed, 3000, 4, step)
        assert sorted(map(tuple, build_profile(frame(spark, rows)).collect())) == sequential(rows)


def test_hot_keys_in_pieces_give_the_same(spark):
    key = Row(*KEY)
    for seed, step in ((1, 2_000), (4, 150), (5, 20_000)):
        rows = records(seed, 3000, 2, step)
        heavy = [key("10.0.0.1", "10.0.0.2", 5, 5, 6), key("10.0.0.1", "10.0.0.3", 0, 0, 1)]
        got = build_profile(frame(spark, rows), heavy=heavy, pieces=23)
        assert sorted(map(tuple, got.collect())) == sequential(rows)


def test_totals_are_kept(spark):
    rows = records(9, 2000, 3, 5_000)
    total = build_profile(frame(spark, rows)).selectExpr("sum(packets + packets_rev)", "sum(bytes + bytes_rev)").first()
    assert tuple(total) == (sum(r["packets"] for r in rows), sum(r["bytes"] for r in rows))
