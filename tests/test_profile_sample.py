"""The sampler: how often it reads the profile, and the sums of candidates against those of each candidate alone."""

import random

from pyspark.sql import functions as F

from biflux.operators.profile_metrics import profile_span, raw_sums
from biflux.operators.profile_sample import sample, score_candidates

SCHEMA = ("flow_id long, start_time long, end_time long, l3_proto int, l4_proto int, src_port int, dst_port int,"
          " packets long, bytes long, packets_rev long, bytes_rev long")


def flows(n=600, empty=False):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        start = rng.randrange(60_000)
        rows.append([i, start, start + rng.choice([0, 1, 700, 9_000, 40_000]), rng.choice([4, 6]), rng.choice([1, 6, 17]), rng.randrange(50),
                     rng.randrange(50), rng.randrange(1, 9), rng.randrange(9_000), rng.randrange(9), rng.randrange(9_000)])
    if empty:
        for row in rows[1::7]:
            row[rng.randrange(1, len(row))] = None
    return [tuple(r) for r in rows]


def counted(spark, rows):
    """The profile, and a counter of the rows that were read of it."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, SCHEMA).mapInArrow(through, SCHEMA), read


def test_scores_read_the_profile_three_times(spark):
    rows = flows()
    profile, read = counted(spark, rows)
    assert score_candidates(profile, "flow_id", 0.2, 0.4, candidates=4, seed=3).count() == 4
    # The span, the count of large strata, the sums of the profile and all candidates.
    assert read.value <= 3 * len(rows)


def test_a_sample_reads_the_profile_four_times(spark):
    rows = flows()
    profile, read = counted(spark, rows)
    chosen, best = sample(profile, "flow_id", 0.2, 0.4, candidates=4, seed=3)
    ids = [r["flow_id"] for r in chosen.collect()]
    assert len(ids) == len({*ids}) == round(best["share"] * len(rows)) and 0.2 <= best["share"] <= 0.4
    assert read.value <= 4 * len(rows)


def test_a_flow_gives_few_summands(spark):
    """Not one per metric and window step (12): one for all small groups, one per port, one per end."""
    profile = spark.createDataFrame(flows(), SCHEMA)
    found = raw_sums(profile, profile_span(profile), members={k: F.col("flow_id") % 9 == k for k in range(8)})
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    lowest = [line for line in plan.splitlines() if "Generate inline" in line][-1]
    assert 0 < lowest.count("struct(") <= 6


def test_candidates_have_the_sums_of_their_rows(spark):
    profile = spark.createDataFrame(flows(empty=True), SCHEMA).localCheckpoint()
    span = profile_span(profile)
    # More than one mask, numbers with gaps, an unknown condition, no row, all rows.
    conditions = {3 * k: f"flow_id % {k + 2} = 0" for k in range(9)} | {40: "src_port < 25", 50: "flow_id < 0", 60: "flow_id >= 0"}
    found = raw_sums(profile, span, members={k: F.expr(c) for k, c in conditions.items()}).collect()

    def of(rows):
        return sorted((r["grp"], str(r["name"]), r["amount"], r["step"]) for r in rows if r["amount"] is not None or r["step"] is not None)

    for k, c in {**conditions, None: "true"}.items():
        assert of(r for r in found if r["candidate"] == k) == of(raw_sums(profile.where(c), span).collect()), c


def test_sums_of_a_profile(spark):
    """A flow over three windows of 5 s and one inside a window, by hand."""
    rows = [(1, 0, 12_000, 4, 6, 80, 443, 10, 100, 2, 20), (2, 5_000, 5_000, 6, 17, 53, 80, 3, 3_000, 0, 0)]
    profile = spark.createDataFrame(rows, SCHEMA)
    span = profile_span(profile)
    found = {(r["grp"], r["name"]): float(r["step"] if r["amount"] is None else r["amount"]) for r in raw_sums(profile, span).collect()}
    assert span == (0, 3)
    assert found == {
        ("total", "packets"): 15, ("total", "bytes"): 3_120, ("total", "flows"): 2, ("l3", "4"): 1, ("l3", "6"): 1, ("size", "small"): 1,
        ("size", "large"): 1, ("proto", "6"): 1, ("proto", "17"): 1, ("port", "80"): 2, ("port", "443"): 1, ("port", "53"): 1,
        ("window", "0"): 5, ("window", "1"): 3, ("window", "2"): -6, ("window", "3"): -2}
