"""Per-second traffic series on a live stream of flows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from biflux.streaming.closing import state_rows

#: Seconds that a series of one batch is kept for at once; sparser batches are laid out flow by flow, so many seconds at once.
LAID_OUT = 131_072
AMOUNTS = ("packets", "bits")


def _series(first: np.ndarray, low: np.ndarray, high: np.ndarray, known: dict, amounts: dict) -> pa.RecordBatch:
    """Sums of flows that lie close together: each is added to its stretch of one array."""
    base, width = int(low.min()), int(high.max() - low.min()) + 1
    low, high = low - base, high - base + 1

    def covering(taken: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(low[taken], minlength=width + 1) - np.bincount(high[taken], minlength=width + 1))[:width]

    met = covering(np.ones(len(low), dtype=bool)) > 0
    sums = {}
    for c in AMOUNTS:
        total = np.zeros(width)
        for start, end, amount in zip(low.tolist(), high.tolist(), amounts[c].tolist()):
            total[start:end] += amount
        sums[c] = pa.array(total[met], mask=covering(known[c])[met] == 0)
    starts = np.bincount(first - base, minlength=width)[met]
    return pa.RecordBatch.from_pydict({"second": pa.array(np.flatnonzero(met) + base), **sums, "starts": pa.array(starts)})


def _laid_out(first: np.ndarray, low: np.ndarray, high: np.ndarray, known: dict, amounts: dict) -> Iterator[pa.RecordBatch]:
    """Sums of any flows, whose seconds are written down in pieces."""
    sizes = high - low + 1
    ends = np.cumsum(sizes)
    for begin in range(0, int(ends[-1]), LAID_OUT):
        end = min(begin + LAID_OUT, int(ends[-1]))
        at, to = np.searchsorted(ends, [begin, end - 1], side="right")
        taken = np.minimum(ends[at:to + 1], end) - np.maximum(ends[at:to + 1] - sizes[at:to + 1], begin)
        row = np.repeat(np.arange(at, to + 1), taken)
        second = np.arange(begin, end) + (low - ends + sizes)[row]
        seconds, place = np.unique(second, return_inverse=True)
        sums = {c: pa.array(np.bincount(place, weights=amounts[c][row]), mask=np.bincount(place, weights=known[c][row]) == 0) for c in AMOUNTS}
        starts = np.bincount(place[second == first[row]], minlength=len(seconds))
        yield pa.RecordBatch.from_pydict({"second": pa.array(seconds), **sums, "starts": pa.array(starts)})


def _per_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flows ``first, last, packets, bits`` (amounts per second) -> sums per second, one row per second and batch or piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        first, last = (batch.column(c).to_numpy() for c in ("first", "last"))
        known = {c: batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in AMOUNTS}
        amounts = {c: batch.column(c).fill_null(0.0).to_numpy() for c in AMOUNTS}
        low, high = np.minimum(first, last), np.maximum(first, last)
        if high.max() - low.min() < LAID_OUT:
            yield _series(first, low, high, known, amounts)
        else:
            yield from _laid_out(first, low, high, known, amounts)


def stream_timeline(flows: DataFrame, lateness: str = "300 seconds") -> DataFrame:
    """Streaming biflows (ms) -> packets, bits and flow starts per second, in append mode.

    A flow is spread evenly over the seconds it lasts. The flows of an Arrow batch are laid out and summed per second
    before the watermark and the shuffle, which see a row per second and batch.
    """
    first, last = F.floor(F.col("start_time") / 1000), F.floor(F.col("end_time") / 1000)
    n = last - first + 1
    spans = flows.where(first.isNotNull() & last.isNotNull()).select(
        first.alias("first"), last.alias("last"), ((F.col("packets") + F.col("packets_rev")) / n).cast("double").alias("packets"),
        ((F.col("bytes") + F.col("bytes_rev")) * 8 / n).cast("double").alias("bits"))
    seconds = spans.mapInArrow(_per_second, "second long, packets double, bits double, starts long")
    timed = seconds.withColumn("time", F.timestamp_seconds("second")).withWatermark("time", lateness)
    return timed.groupBy(F.window("time", "1 second")).agg(
        F.sum("packets").alias("packets"), F.sum("bits").alias("bits"), F.sum("starts").alias("starts"),
    ).select(F.unix_seconds("window.start").alias("second"), "packets", "bits", "starts")


def open_seconds(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Seconds that the watermark of a stopped stream has not passed: the rest of the series."""
    sums = F.col("value").cast("struct<packets:double,bits:double,starts:bigint>").alias("sums")
    return state_rows(spark, checkpoint).select(F.unix_seconds("key.window.start").alias("second"), sums).select("second", "sums.*")
