"""Trim a profile to a main interval with a tolerance interval on both sides."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from biflux.functions.draws import draw_bits, uniform_between
from biflux.schemas import FlowDataError

MIN_BYTES = 40


@dataclass(frozen=True)
class TrimSpec:
    """Lengths and positions in ms: either a centred main interval or explicit borders."""

    tolerance: int
    main: int | None = None
    left: int | None = None
    right: int | None = None

    def __post_init__(self):
        if self.tolerance < 0:
            raise FlowDataError("tolerance must not be negative")
        if (self.left is None) != (self.right is None):
            raise FlowDataError("both borders of the main interval are needed")
        if (self.main is None) == (self.left is None):
            raise FlowDataError("give either the main interval or its borders")
        if self.main is not None and self.main <= 0:
            raise FlowDataError("the main interval must be positive")
        if self.left is not None and self.left > self.right:
            raise FlowDataError("the left border is after the right one")


def trim_bounds(profile: DataFrame, spec: TrimSpec) -> Column:
    """Scalar struct ``left, right, outer_left, outer_right``; an error for flows that span no time, null without flows."""
    first, last = F.min("start_time"), F.max("end_time")
    if spec.main is not None:
        middle = first + (last - first) / 2
        left, right = middle - spec.main / 2, middle + spec.main / 2
    else:
        left, right = F.lit(float(spec.left)), F.lit(float(spec.right))
    borders = F.struct(
        left.alias("left"), right.alias("right"), (left - spec.tolerance).alias("outer_left"),
        (right + spec.tolerance).alias("outer_right"))
    return profile.agg(F.when(last <= first, F.raise_error(F.lit("the profile spans no time"))).otherwise(borders)).scalar()


def trim_category(bounds: Column) -> Column:
    """nonaltered (inside), tolerance (inside a tolerance interval), dropped (outside) or scaled (across a border)."""
    start, end = F.col("start_time"), F.col("end_time")
    left, right, outer_left, outer_right = (bounds[c] for c in ("left", "right", "outer_left", "outer_right"))
    near = ((start >= outer_left) & (end <= left) & (start != left)) | ((start >= right) & (end <= outer_right) & (end != right))
    out = ((start < outer_left) & (end < left)) | ((start > right) & (end > outer_right))
    return (
        F.when((start >= left) & (end <= right), "nonaltered").when(near, "tolerance").when(out, "dropped").otherwise("scaled")
    )


def with_trim_category(profile: DataFrame, spec: TrimSpec) -> DataFrame:
    bounds = trim_bounds(profile, spec)
    return profile.withColumn("bounds", bounds).withColumn("category", trim_category(F.col("bounds")))


def keep_exact_half(rows: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Exactly half of the rows (half to even), those first in hash order.

    The hash is cut into 65536 even slots. A running count over the slots gives each row its global rank while rows
    are only ordered inside a slot.
    """
    hashed = rows.withColumn("_h", draw_bits(seed, F.col(row_id), "half")).withColumn("_slot", F.shiftrightunsigned("_h", 48))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = hashed.groupBy("_slot").agg(F.count("*").alias("_n")).select(
        "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    total = hashed.agg(F.bround(F.count("*") / 2).cast("long")).scalar()
    rank = F.row_number().over(Window.partitionBy("_slot").orderBy("_h", row_id))
    ranked = hashed.join(F.broadcast(slots), "_slot").withColumn("_rank", F.col("_before") + rank)
    return ranked.where(F.col("_rank") <= total).select(*rows.columns)


def _shift_and_scale(rows: DataFrame, row_id: str, seed: int) -> DataFrame:
    start, end, bounds = F.col("start_time"), F.col("end_time"), F.col("bounds")
    key = (seed, F.col(row_id))
    new_start = F.when(start < bounds["left"], uniform_between(
        F.greatest(bounds["outer_left"], start), bounds["left"], *key, "start").cast("long")).otherwise(start)
    new_end = F.when(end > bounds["right"], uniform_between(
        bounds["right"], F.least(bounds["outer_right"], end), *key, "end").cast("long")).otherwise(end)
    moved = rows.withColumns({"s": new_start, "e": new_end}).where(F.col("s") < F.col("e"))
    ratio = F.least(F.bround((F.col("e") - F.col("s")) / (end - start), 3), F.lit(1.0))
    moved = moved.withColumn("ratio", ratio)
    changes = {}
    for p, b in (("packets", "bytes"), ("packets_rev", "bytes_rev")):
        some = (F.col(p) > 0) | (F.col(b) > 0)
        packets, octets = ((F.col(c) * F.col("ratio")).cast("long") for c in (p, b))
        tiny = (packets == 0) | (octets < MIN_BYTES)
        changes[p] = F.when(some, F.when(tiny, F.lit(1)).otherwise(packets)).otherwise(F.col(p)).cast("long")
        changes[b] = F.when(some, F.when(tiny, F.greatest(F.lit(MIN_BYTES), octets)).otherwise(octets)).otherwise(F.col(b)).cast("long")
    scaled = moved.withColumns(changes)
    single = F.col("packets") + F.col("packets_rev") == 1
    return scaled.withColumns({"start_time": F.col("s"), "end_time": F.when(single, F.col("s")).otherwise(F.col("e"))}).drop("s", "e", "ratio")


def trim(profile: DataFrame, spec: TrimSpec, row_id: str, seed: int = 0) -> DataFrame:
    """Trimmed profile with its ``category``: inside rows as they are, half of the tolerance rows, border rows cut."""
    marked = with_trim_category(profile, spec)
    inside = marked.where(F.col("category") == "nonaltered")
    half = keep_exact_half(marked.where(F.col("category") == "tolerance"), row_id, seed)
    cut = _shift_and_scale(marked.where(F.col("category") == "scaled"), row_id, seed)
    return inside.unionByName(half).unionByName(cut).drop("bounds")


def trim_statistics(marked: DataFrame, trimmed: DataFrame) -> DataFrame:
    """Counts and sums before and after: ``item, original, trimmed, ratio`` (0 when the original is 0).

    ``marked`` is the original with its trim category. Altered counts all border rows, also those that were then dropped.
    """
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("packets", "bytes", "packets_rev", "bytes_rev")}
    before = marked.agg(
        F.count("*").alias("flows"), *[v.alias(c) for c, v in sums.items()],
        F.count_if(F.col("category") == "nonaltered").alias("nonaltered"),
        F.count_if(F.col("category") == "scaled").alias("altered"))
    after = trimmed.agg(F.count("*").alias("flows"), *[v.alias(c) for c, v in sums.items()])
    items = ["flows", *sums]
    old = before.select(F.inline(F.array(
        *[F.struct(F.lit(c).alias("item"), F.col(c).alias("original"), F.lit(None).cast("long").alias("kept")) for c in items],
        *[F.struct(F.lit(c).alias("item"), F.lit(0).cast("long").alias("original"), F.col(c).alias("kept")) for c in ("nonaltered", "altered")],
    )), F.col("flows").alias("all_flows"))
    new = after.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("trimmed")) for c in items])))
    table = old.join(new, "item", "left").select("item", "original", F.coalesce("trimmed", "kept").alias("trimmed"), "all_flows")
    gone = table.where(F.col("item") == "flows").select(
        F.lit("dropped").alias("item"), F.lit(0).cast("long").alias("original"),
        (F.col("original") - F.col("trimmed")).alias("trimmed"), "all_flows")
    divisor = F.when(F.col("item").isin("nonaltered", "altered", "dropped"), F.col("all_flows")).otherwise(F.col("original"))
    return table.unionByName(gone).select(
        "item", "original", "trimmed",
        F.when(divisor == 0, 0.0).otherwise(F.round(F.col("trimmed") / divisor, 2)).alias("ratio"))
