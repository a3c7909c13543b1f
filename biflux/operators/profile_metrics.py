"""Metrics of a traffic profile, their distance to another profile, and per-second series."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from biflux.functions.scalars import rel_diff_percent, size_class
from biflux.runtime import durable
from biflux.skew import global_scan

SIZE_CLASSES = ["small", "medium", "large", "huge"]
DEFAULT_THRESHOLD = 0.005
DEFAULT_WINDOW = 5


def _both(name: str) -> Column:
    """Sum of a counter over both directions."""
    return F.col(name) + F.col(f"{name}_rev")


class Span(NamedTuple):
    """First start (ms) of a profile and the number of windows that cover it."""

    first: int
    windows: int


def profile_span(profile: DataFrame, window_length: int = DEFAULT_WINDOW) -> Span:
    seconds = F.ceil((F.max("end_time") - F.min("start_time")) / 1000)
    windows = F.greatest(F.ceil(seconds / window_length), F.lit(1))
    return Span(*profile.agg(F.min("start_time"), windows.cast("long")).first())


_STEP = "decimal(38,12)"
#: Candidates whose flags form one mask: a sum per mask (at most 256) serves all of them.
_FLAGS = 8


def _item(group: str, key: Column, amount: Column | None, step: Column | None = None) -> Column:
    """A summand; ``step`` is for amounts that are taken away again later and must then leave exactly nothing."""
    none = F.lit(None)
    return F.struct(
        F.lit(group).alias("grp"), key.cast("string").alias("name"), (none if amount is None else amount).cast("double").alias("amount"),
        (none if step is None else step).cast(_STEP).alias("step"))


def _with_windows(rows: DataFrame, span: Span, window_length: int) -> DataFrame:
    """Add the first and the last window of a flow and its packets in the first, in the last and in each window between.

    The packets are spread evenly over the flow, so the packets-per-window series is a running sum of a few steps, however
    long the flow is.
    """
    length = window_length * 1000
    last = F.lit(span.windows - 1)
    start, end = F.col("start_time") - span.first, F.col("end_time") - span.first
    rate = F.col("_packets") / F.nullif(end - start, F.lit(0))
    rows = rows.withColumns({"_first": F.least(F.floor(start / length), last), "_last": F.least(F.floor(end / length), last)})
    shares = {"_head": (F.least((F.col("_first") + 1) * length, end) - start) * rate, "_tail": (end - F.col("_last") * length) * rate,
              "_whole": length * rate}
    return rows.withColumns({n: c.cast(_STEP) for n, c in shares.items()})


def _part(kind: str, chunk: int, **fields: Column) -> Column:
    """A summand of the first aggregation. ``kind`` to ``mask`` are its group, ``flags`` are counted one by one."""
    types = {"l3": "string", "l4": "string", "size": "string", "port": "string", "at": "long", "mask": "int", "flags": "int",
             "packets": "double", "octets": "double", "now": _STEP, "next": _STEP}
    return F.struct(F.lit(kind).alias("kind"), F.lit(chunk).alias("chunk"), *[
        fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def raw_sums(profile: DataFrame, span: Span, window_length: int = DEFAULT_WINDOW, members: dict[int, Column] | None = None) -> DataFrame:
    """All sums the metrics need, from one scan: ``grp, name, amount, step``.

    With ``members`` (conditions by candidate number), also the sums of every candidate, with a column ``candidate`` that
    is NULL for the whole profile. The rows are summed per mask of candidates first (ports, of which there are many, per
    flag), so neither the rows nor the costly decimal sums are repeated per candidate.
    """
    members = members or {}
    chunks = [[*members][i:i + _FLAGS] for i in range(0, max(len(members), 1), _FLAGS)]
    bits = {c: [F.when(members[k], 1 << j).otherwise(0) for j, k in enumerate(ks)] for c, ks in enumerate(chunks)}
    # Everything a flow's summands share is computed below the generator, once per flow.
    rows = profile.select(
        "l3_proto", "l4_proto", "src_port", "dst_port", "start_time", "end_time", _both("packets").alias("_packets"),
        _both("bytes").alias("_bytes"), size_class(_both("bytes"), _both("packets")).alias("_size"),
        *[sum(b, F.lit(0)).alias(f"_mask{c}") for c, b in bits.items()])
    rows = _with_windows(rows, span, window_length)
    packets, head, tail, whole = (F.col(n) for n in ("_packets", "_head", "_tail", "_whole"))
    first, last = F.col("_first"), F.col("_last")
    parts = []
    for c in bits:
        mask = F.col(f"_mask{c}")
        base = _part("base", c, l3=F.col("l3_proto"), l4=F.col("l4_proto"), size=F.col("_size"), mask=mask, packets=packets, octets=F.col("_bytes"))
        ports = [_part("port", c, port=F.col(p), flags=mask) for p in ("src_port", "dst_port")]
        one = _part("window", c, at=first, mask=mask, now=packets, next=-packets)
        many = [_part("window", c, at=first, mask=mask, now=head, next=whole - head), _part("window", c, at=last, mask=mask, now=tail - whole, next=-tail)]
        parts += [F.array(base, *ports), F.when(first == last, F.array(one)).otherwise(F.array(*many))]

    def flag(of: str, j: int) -> Column:
        return F.col(of).bitwiseAND(1 << j) != 0

    width = range(len(chunks[0]))
    keys = ["kind", "chunk", "l3", "l4", "size", "port", "at", "mask"]
    parted = rows.select(F.inline(F.concat(*parts))).groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("packets", "octets", "now", "next")],
        *[F.sum(F.when(flag("flags", j), 1)).cast("double").alias(f"_n{j}") for j in width])

    n = F.col("n")
    items = F.when(F.col("kind") == "base", F.array(
        _item("total", F.lit("packets"), F.col("packets")), _item("total", F.lit("bytes"), F.col("octets")), _item("total", F.lit("flows"), n),
        _item("l3", F.col("l3"), n), _item("size", F.col("size"), n), _item("proto", F.col("l4"), n),
    )).when(F.col("kind") == "port", F.array(_item("port", F.col("port"), n))).otherwise(F.array(
        _item("window", F.col("at"), None, F.col("now")), _item("window", F.col("at") + 1, None, F.col("next"))))
    sums = parted.select("chunk", "mask", *[f"_n{j}" for j in width], F.inline(items)).groupBy("chunk", "grp", "name").agg(
        F.sum("amount").alias("amount"), F.sum("step").alias("step"),
        *[F.sum(F.coalesce(f"_n{j}", F.when(flag("mask", j), F.col("amount")))).alias(f"_amount{j}") for j in width],
        *[F.sum(F.when(flag("mask", j), F.col("step"))).alias(f"_step{j}") for j in width])
    if not members:
        return sums.select("grp", "name", "amount", "step")

    def of(candidate: int | None, suffix: str) -> Column:
        return F.struct(F.lit(candidate).cast("int").alias("candidate"), F.col(f"{'_' if suffix else ''}amount{suffix}").alias("amount"),
                        F.col(f"{'_' if suffix else ''}step{suffix}").alias("step"))

    each = F.array(*[of(k, str(j)) for j, k in enumerate(chunks[0])], of(None, ""))
    for c, ks in enumerate(chunks[1:], start=1):
        each = F.when(F.col("chunk") == c, F.array(*[of(k, str(j)) for j, k in enumerate(ks)])).otherwise(each)
    return sums.select("grp", "name", F.inline(each)).where("candidate IS NULL OR amount IS NOT NULL OR step IS NOT NULL")


def metric_table(
    profile: DataFrame,
    span: Span,
    proto_threshold: float = DEFAULT_THRESHOLD,
    port_threshold: float = DEFAULT_THRESHOLD,
    window_length: int = DEFAULT_WINDOW,
    members: dict[int, Column] | None = None,
    totals: bool = False,
    sums: DataFrame | None = None,
) -> DataFrame:
    """Long table ``grp, name, value``: ratios, address version, packet size, protocol, port and window shares and, with
    ``totals``, the number of flows. With ``members`` the same per ``candidate``. ``sums``: the rows of :func:`raw_sums` to
    use, if there are any already.

    Everything after :func:`raw_sums` works on its result (at most 256 protocols, 65536 ports and the windows).
    """
    by = ["candidate"] if members else []
    if sums is None:
        sums = durable(raw_sums(profile, span, window_length, members))
        sums = sums.where("candidate IS NOT NULL") if by else sums
    value = {n: F.max(F.when((F.col("grp") == "total") & (F.col("name") == n), F.col("amount"))) for n in ("packets", "bytes", "flows")}
    # One row, or one per candidate.
    whole = sums.groupBy(*by).agg(*[v.alias(f"t_{n}") for n, v in value.items()])
    sums = sums.join(F.broadcast(whole), by) if by else sums.select("*", *[whole.select(f"t_{n}").scalar().alias(f"t_{n}") for n in value])
    packets, octets, flows = (F.col(f"t_{n}") for n in ("packets", "bytes", "flows"))
    keep = [*by, "grp", "name", "value"]

    ratios = sums.where((F.col("grp") == "total") & (F.col("name") == "flows")).select(*by, F.inline(F.array(*[
        F.struct(F.lit("ratio").alias("grp"), F.lit(n).alias("name"), v.alias("value"))
        for n, v in (("pkts_bts", packets / octets), ("bfls_pkts", flows / packets), ("bfls_bts", flows / octets))
    ])))
    divisor = F.when(F.col("grp") == "port", 2 * flows).otherwise(flows)
    threshold = F.when(F.col("grp") == "proto", proto_threshold).when(F.col("grp") == "port", port_threshold).otherwise(0.0)
    shares = sums.where(F.col("grp").isin("l3", "size", "proto", "port"))
    shares = shares.withColumn("value", F.col("amount") / divisor).where(F.col("value") >= threshold).select(*keep)
    at = F.col("name").cast("long")
    steps = sums.where((F.col("grp") == "window") & (at < span.windows)).select(*by, at.alias("at"), "step", packets.alias("packets"))
    if by:
        series = Window.partitionBy("candidate").orderBy("at")
        steps = steps.select("*", F.sum("step").over(series).alias("now"), F.coalesce(F.lead("at").over(series), F.lit(span.windows)).alias("until"))
        steps = steps.withColumn("at", F.explode(F.sequence(F.col("at"), F.col("until") - 1)))
    else:  # every window, then a running sum over ranges of them
        axis = profile.sparkSession.range(span.windows).toDF("at")
        steps = global_scan(axis.join(steps.drop("packets"), "at", "left"), ["at"], total={"before": F.col("step")})
        steps = steps.select("at", (F.col("before") + F.coalesce("step", F.lit(0))).alias("now"), whole.select("t_packets").scalar().alias("packets"))
    windows = steps.select(
        *by, F.lit("window").alias("grp"), F.col("at").cast("string").alias("name"), (F.col("now").cast("double") / F.col("packets")).alias("value"))
    table = ratios.unionByName(shares).unionByName(windows)
    if totals:
        count = sums.where((F.col("grp") == "total") & (F.col("name") == "flows"))
        table = table.unionByName(count.select(*by, "grp", "name", F.col("amount").alias("value")))
    return table


def window_rsd(metrics: DataFrame, span: Span) -> DataFrame:
    """Relative standard deviation of packets over all windows, silent ones included."""
    n = F.lit(float(span.windows))
    share = F.col("value")
    inside = metrics.where(F.col("grp") == "window").agg(
        F.sum(share * share).alias("squares"), F.sum(share).alias("total"))
    mean = 1 / n
    variance = F.col("squares") / n - 2 * mean * F.col("total") / n + mean * mean
    return inside.select((F.sqrt(F.greatest(variance, F.lit(0.0))) / mean).alias("rsd"))


def metric_diff(original: DataFrame, sample: DataFrame, candidates: list[int] | None = None) -> DataFrame:
    """``grp, name, original, solution, diff`` in percent for every metric of the original; with ``candidates``, for each of
    these."""
    by = ["candidate"] if candidates else []
    sample = sample.withColumnRenamed("value", "solution")
    original = original.withColumnRenamed("value", "original")
    if candidates:
        original = original.withColumn("candidate", F.explode(F.array(*[F.lit(k) for k in candidates])))
    joined = original.join(sample, [*by, "grp", "name"], "left")
    value = F.coalesce(F.col("solution"), F.lit(0.0))
    return joined.select(*by, "grp", "name", "original", value.alias("solution"),
                         rel_diff_percent(value, F.col("original")).alias("diff"))


def fitness(diff: DataFrame, deviation: float, by: list[str] | None = None) -> DataFrame:
    """Fitness 0..100 and whether every metric stays within the deviation."""
    is_window = F.col("grp") == "window"
    single = F.coalesce(F.sum(F.when(~is_window, F.col("diff") * F.col("diff"))), F.lit(0.0))
    mean = F.coalesce(F.avg(F.when(is_window, F.col("diff"))), F.lit(0.0))
    score = (100 - single) / 2 + (100 - mean * mean) / 2
    return diff.groupBy(*(by or [])).agg(
        F.greatest(score, F.lit(0.0)).alias("fitness"), F.max("diff").alias("worst"),
        (F.max("diff") <= deviation * 100).alias("accepted"),
    )


def top_share(metrics: DataFrame, group: str, limit: int) -> DataFrame:
    """The largest protocol or port shares."""
    return metrics.where(F.col("grp") == group).orderBy(F.col("value").desc(), F.col("name")).limit(limit)


def timeline(profile: DataFrame, inactive_timeout: int = 30) -> DataFrame:
    """Per second: kpps, Mbit/s (1024 * 1024), active flows (kept for the inactive timeout), starts and ends.

    A flow adds its rate when it starts and takes it away after its last second, so it gives two rows whatever its
    length; the running sum goes over one row per second.
    """
    start, end = F.floor(F.col("start_time") / 1000), F.floor(F.col("end_time") / 1000)
    seconds = end - start + 1
    # Decimals: what a flow adds is taken away exactly, however many flows come between.
    rates = {"kpps": _both("packets") / seconds / 1000, "mbps": _both("bytes") * 8 / seconds / (1024 * 1024)}
    rates = {n: v.cast("decimal(38,16)") for n, v in rates.items()}

    def step(at: Column, traffic: int, active: int, starts: int, ends: int) -> Column:
        return F.struct(at.alias("second"), *[(v * traffic).alias(n) for n, v in rates.items()],
                        *[F.lit(v).cast("long").alias(n) for n, v in
                          (("active", active), ("starts", starts), ("ends", ends))])

    steps = F.array(step(start, 1, 1, 1, 0), step(end, 0, 0, 0, 1), step(end + 1, -1, 0, 0, 0),
                    step(end + 1 + inactive_timeout, 0, -1, 0, 0))
    fields = ["kpps", "mbps", "active", "starts", "ends"]
    per_second = profile.select(F.inline(steps)).groupBy("second").agg(*[F.sum(c).alias(c) for c in fields])
    first, last = profile.agg(F.min("start_time"), F.max("end_time")).first()
    axis = profile.sparkSession.range(first // 1000, last // 1000 + inactive_timeout + 1).toDF("second")
    dense = axis.join(per_second, "second", "left").select("second", *[F.coalesce(c, F.lit(0).cast(per_second.schema[c].dataType)).alias(c) for c in fields])
    running = ["kpps", "mbps", "active"]
    scanned = global_scan(dense, ["second"], total={f"_{c}": F.col(c) for c in running})
    return scanned.select(
        "second", *[(F.col(f"_{c}") + F.col(c)).cast("long" if c == "active" else "double").alias(c) for c in running], "starts", "ends")
