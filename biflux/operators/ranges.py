"""Addresses against a table of address ranges, overlapping ones included.

A range is the disjoint union of a few blocks of addresses with a common beginning (at most 30 per hex digit, one for a
subnet on a digit's border). An address is in a range if one of its beginnings is one of the range's blocks, so the join
is an equality join per length of beginning that occurs, and gives nothing but the hits.
"""

from pyspark.sql import Column, DataFrame, functions as F

from biflux.runtime import broadcast_if_small, durable, once, shuffled
from biflux.skew import keyed_scan

DIGITS = "0123456789abcdef"
#: Beginnings of so few digits can take a large share of all addresses: their rows are dealt over SALTS places.
SHORT, SALTS = 3, 64


def cover(low: Column, high: Column) -> Column:
    """Beginnings whose addresses are exactly those from ``low`` to ``high`` (canonical hex of one width)."""
    digits = F.array(*[F.lit(d) for d in DIGITS])
    head = F.size(F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i)))
    ends = [F.length(F.rtrim(low, F.lit("0"))), F.length(F.rtrim(high, F.lit("f")))]
    whole = (ends[0] <= head) & (ends[1] <= head)

    def beside(bound: Column, end: Column, above: bool) -> Column:
        """Blocks on the inner side of a bound, digit by digit, and the block of the bound itself."""
        def at(i: Column) -> Column:
            own = F.substring(bound, i, F.lit(1))
            inner = F.filter(digits, lambda d: d > own if above else d < own)
            return F.transform(inner, lambda d: F.concat(F.substring(bound, F.lit(1), i - 1), d))

        steps = F.when(end >= head + 2, F.flatten(F.transform(F.sequence(head + 2, end), at))).otherwise(F.array().cast("array<string>"))
        return F.concat(steps, F.array(F.substring(bound, F.lit(1), end)))

    first, last = F.substring(low, head + 1, F.lit(1)), F.substring(high, head + 1, F.lit(1))
    between = F.transform(F.filter(digits, lambda d: (d > first) & (d < last)), lambda d: F.concat(F.substring(low, F.lit(1), head), d))
    sides = [beside(b, F.greatest(end, head + 1), above) for b, end, above in ((low, ends[0], True), (high, ends[1], False))]
    return F.when(whole, F.array(F.substring(low, F.lit(1), head))).otherwise(F.concat(between, *sides))


def _salted(prefix: Column, salt: Column) -> Column:
    return F.when(F.length(prefix) <= SHORT, salt).otherwise(0)


def range_hits(addresses: DataFrame, ranges: DataFrame, column: str = "address") -> DataFrame:
    """``address, range_id`` of every hit. ``ranges`` have ``range_id, low, high``; each different address is joined once.

    Ranges whose bounds differ in version or order, or are null, hold nothing. A table of ranges counted to be small is
    broadcast; a larger one is shuffled with the addresses, where short beginnings are spread.
    """
    sound = (F.length("low") == F.length("high")) & (F.col("low") <= F.col("high"))
    blocks = ranges.where(sound).select("range_id", F.length("low").alias("width"), F.explode(cover(F.col("low"), F.col("high"))).alias("prefix"))
    lengths = sorted(r[0] for r in blocks.select(F.length("prefix")).distinct().collect())  # at most 33
    points = addresses.select(F.col(column).alias("address")).where(F.col("address").isNotNull()).distinct()
    beginnings = F.array_distinct(F.array(*[F.substring("address", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    points = points.select("address", F.length("address").alias("width"), F.explode(beginnings).alias("prefix"))
    small = broadcast_if_small(blocks)
    keys = ["width", "prefix"]
    if small is blocks:
        spread = F.when(F.length("prefix") <= SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        small = shuffled(blocks.select("*", F.explode(spread).alias("salt")))
        points = points.withColumn("salt", _salted(F.col("prefix"), F.pmod(F.xxhash64("address"), F.lit(SALTS))).cast("int"))
        keys.append("salt")
    return points.join(small, keys).select("address", "range_id")


def _keyed(address: Column) -> Column:
    """Addresses of all versions in one order: the width, then the digits."""
    return F.concat(F.lpad(F.length(address).cast("string"), 3, "0"), address)


def _disjoint(ranges: DataFrame) -> DataFrame:
    """``range_id, spans``: the sound ranges of each id as disjoint spans of keyed addresses in ascending order."""
    sound = (F.length("low") == F.length("high")) & (F.col("low") <= F.col("high")) & F.col("range_id").isNotNull()
    spans = ranges.where(sound).groupBy("range_id").agg(
        F.array_sort(F.collect_set(F.struct(_keyed(F.col("low")).alias("low"), _keyed(F.col("high")).alias("high")))).alias("spans"))

    def merged(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))
        met = F.coalesce(last["high"] >= x["low"], F.lit(False))
        return F.when(met, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return spans.select("range_id", F.aggregate("spans", F.array().cast("array<struct<low:string,high:string>>"), merged).alias("spans"))


def _met(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``range_id, flows, bytes`` of the pairs with an end in a range of the id, summed without a row per hit.

    With ``x <= y`` the ends of a pair, it is met if ``y`` is inside, or if ``x`` is and ``y`` is above the span and in no
    later span of the id. The first are sums per beginning; the second are, per beginning of ``x``, sums over all larger
    ``y``: one running sum over pairs and bounds in the order of ``y``.
    """
    spans = _disjoint(ranges)
    blocks = spans.select("range_id", "spans", F.posexplode("spans").alias("at", "span"))
    blocks = once(blocks, {"width": F.substring("span.low", 1, 3), **{
        c: F.substring(F.col(f"span.{c}"), F.lit(4), F.length(f"span.{c}") - 3) for c in ("low", "high")}})
    # Covering costs far more than a row's bytes suggest: as many tasks as the session has, not what the size calls for.
    blocks = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "range_id", "at")
    blocks = durable(blocks.select("range_id", "spans", "at", "width", F.explode(cover(F.col("low"), F.col("high"))).alias("prefix")))
    lengths = {r[0]: sorted(r[1]) for r in blocks.groupBy("width").agg(F.collect_set(F.length("prefix"))).collect()}  # at most 33 a version
    ends = pairs.where(F.coalesce("src_ip", "dst_ip").isNotNull()).select(
        *[f(_keyed(F.col("src_ip")), _keyed(F.col("dst_ip"))).alias(n) for n, f in (("x", F.least), ("y", F.greatest))], "flows", F.coalesce("bytes", F.lit(0)).alias("bytes"))

    def beginnings(end: str, of: Column | None = None) -> Column:
        """Those lengths that a block has; with ``of`` only where the other end begins otherwise."""
        made = F.array().cast("array<string>")
        for width, sizes in lengths.items():
            taken = [F.substring(end, 1, 3 + n) for n in sizes]
            made = F.when(F.substring(end, 1, 3) == width, F.array(*[
                t if of is None else F.when(~of.startswith(t), t) for t in taken])).otherwise(made)
        return F.array_compact(made)

    sums = [F.sum(c).alias(c) for c in ("flows", "bytes")]
    asked = blocks.select("range_id", "spans", "at", F.concat("width", "prefix").alias("prefix"))
    prefixes = asked.select("prefix").distinct()
    known = broadcast_if_small(prefixes)
    known = shuffled(known) if known is prefixes else known
    inside = ends.select(F.explode(beginnings("y")).alias("prefix"), "flows", "bytes").groupBy("prefix").agg(*sums)
    inside = asked.select("range_id", "prefix").join(shuffled(inside), "prefix").select("range_id", "flows", "bytes")
    # Later keys have smaller complements: the sum over earlier rows is that over all larger y. Bounds go before equal ends.
    turned = lambda c: F.translate(c, DIGITS, DIGITS[::-1])
    above = ends.select(F.explode(beginnings("x", F.col("y"))).alias("prefix"), turned(F.col("y")).alias("end"), "flows", "bytes").join(
        known, "prefix", "left_semi").groupBy("prefix", "end").agg(*sums)
    later = F.slice("spans", F.col("at") + 2, F.size("spans"))
    bounds = F.flatten(F.array(
        F.transform(F.slice("spans", F.col("at") + 1, F.size("spans")), lambda s: F.struct(turned(s["high"]).alias("end"), F.lit(0).alias("turn"), F.lit(1).alias("sign"))),
        F.transform(later, lambda s: F.struct(turned(s["low"]).alias("end"), F.lit(2).alias("turn"), F.lit(-1).alias("sign")))))
    bounds = asked.select("range_id", "prefix", F.inline(bounds))
    none = F.lit(0).cast("long")
    places = bounds.select("prefix", "end", "turn").distinct().select("*", none.alias("flows"), none.alias("bytes"))
    line = durable(above.select("prefix", "end", F.lit(1).alias("turn"), "flows", "bytes").unionByName(places))
    head = {"_head": F.substring(F.col("end"), F.lit(1), F.length("end") - 3)}
    passed = keyed_scan(line, ["prefix"], ["end", "turn"], head, total={"_flows": F.col("flows"), "_bytes": F.col("bytes")})
    passed = passed.where("turn <> 1").select("prefix", "end", "turn", "_flows", "_bytes")
    beyond = bounds.join(shuffled(passed), ["prefix", "end", "turn"]).select(
        "range_id", (F.col("sign") * F.col("_flows")).alias("flows"), (F.col("sign") * F.col("_bytes")).alias("bytes"))
    return inside.unionByName(beyond).groupBy("range_id").agg(*sums)


def range_share(flows: DataFrame, ranges: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per range the flows with an end in it, their bytes, the share among all hits of its address version, and whether that
    is within ``tolerance`` of ``expected``.

    A flow counts once per range, also if both its ends are in it. A version without a hit has no shares and fails. Flows
    are counted per pair of addresses first. Several ranges of one id count as their union; their number is paid squared.
    """
    pairs = flows.groupBy("src_ip", "dst_ip").agg(
        F.count("*").alias("flows"), F.sum(F.col("bytes") + (F.col("bytes_rev") if "bytes_rev" in flows.columns else F.lit(0))).alias("bytes"))
    counted = _met(durable(pairs), ranges)
    found = ranges.select("range_id", F.length("low").alias("width"), "expected").join(shuffled(counted), "range_id", "left").fillna(0, ["flows", "bytes"])
    totals = found.groupBy("width").agg(F.sum("flows").alias("all_flows"), F.sum("bytes").alias("all_bytes"))
    share = F.try_divide(F.col("flows"), F.col("all_flows"))
    return found.join(totals, "width").select(
        "range_id", "flows", "bytes", share.alias("share"), F.try_divide(F.col("bytes"), F.col("all_bytes")).alias("share_bytes"), "expected",
        F.coalesce(F.abs(share - F.col("expected")) <= tolerance, F.lit(False)).alias("passed"))
