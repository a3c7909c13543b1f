"""Streaming profile builder: the flow cache as keyed state.

The batch builder and this one share the merge rules, so a stream that arrives in order gives the batch profile.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from biflux.operators import fold
from biflux.operators.profile_build import ACTIVE, INACTIVE, KEY, _as_profile, keyed_records
from biflux.streaming.closing import drain, state_rows

_OUT = (
    "a_ip string, b_ip string, a_port int, b_port int, proto int, l3_proto int, start_time long, end_time long,"
    " swap boolean, p0 long, b0 long, p1 long, b1 long"
)
_STATE = "start long, end long, swap boolean, p0 long, b0 long, p1 long, b1 long, reversed boolean, l3_proto int"
_NAMES = [c.strip().split()[0] for c in _OUT.split(",")]
_RECORD = ["start_time", "end_time", "swap", "packets", "bytes", "l3_proto"]


def _in_arrival_order(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """Rows of a micro-batch by ``arrival_seq``. They are kept as arrays, and become Python values a few at a time."""
    kept: dict[str, list] = {c: [] for c in ["arrival_seq", *columns]}
    for batch in batches:
        for c, parts in kept.items():
            parts.append(batch[c].to_numpy())
    whole = {c: np.concatenate(parts) for c, parts in kept.items()}
    order = np.argsort(whole["arrival_seq"], kind="stable")
    for k in range(0, len(order), 10_000):
        yield from zip(*(whole[c][order[k:k + 10_000]].tolist() for c in columns))


def _cache(inactive: int, active: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *stored, l3 = state.get if state.exists else (*[None] * 8, None)
        flow = None if not state.exists else [*stored[:2], bool(stored[2]), *stored[3:7], bool(stored[7])]
        done = []

        def close():
            done.append((*key, l3, flow[fold.START], flow[fold.END], flow[fold.SWAP], *flow[fold.P0:fold.REVERSED]))

        if state.hasTimedOut:
            if flow is not None:
                close()
            state.remove()
        else:
            for start, end, swap, packets, octets, version in _in_arrival_order(batches, _RECORD):
                if flow is not None and fold.absorb(flow, start, end, swap, packets, octets, inactive, active):
                    continue
                if flow is not None:
                    close()
                flow, l3 = fold.open_flow(start, end, swap, packets, octets), version
            state.update((*flow, l3))
            # Time stamps of the watermark are event times; the state never expires before it could still be extended.
            due = flow[fold.END] + max(int(1.5 * active), inactive)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=_NAMES)

    return update


def stream_profile(records: DataFrame, inactive: int = INACTIVE, active: int = ACTIVE) -> DataFrame:
    """Streaming uniflow records (epoch ms, ``arrival_seq``) -> finished biflows, in append mode.

    A flow leaves the cache when a record opens its successor, or when the watermark has passed its end by one and a
    half active timeouts. Records may be late by the active timeout.
    """
    timed = records.withColumn("event_time", F.timestamp_millis("end_time")).withWatermark("event_time", f"{active} milliseconds")
    rows = keyed_records(timed).select(
        *KEY, "event_time", "arrival_seq", "start_time", "end_time", "swap", "packets", "bytes", "l3_proto")
    flows = rows.groupBy(*KEY).applyInPandasWithState(
        _cache(inactive, active), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _as_profile(flows)


def run_profile_stream(records: DataFrame, sink: str, checkpoint: str, inactive: int = INACTIVE, active: int = ACTIVE):
    """Drain what is available into a parquet table; flows still open wait in the state for the next run."""
    return (
        stream_profile(records, inactive, active).writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Profile rows of the flows that a stopped stream holds open."""
    kept = state_rows(spark, checkpoint).select("key.*", "value.groupState.*")
    return _as_profile(kept.withColumnsRenamed({"start": "start_time", "end": "end_time"}))


def close_profile_stream(records: DataFrame, sink: str, checkpoint: str, inactive: int = INACTIVE, active: int = ACTIVE) -> tuple[DataFrame, int]:
    """End of input: the whole profile (finished flows, then those still open), and the number of rows that came too late.

    The state is only read, so the stream can go on later; the flows that were open are then given again.
    """
    spark = records.sparkSession
    late = sum(b["late"] for b in drain(run_profile_stream(records, sink, checkpoint, inactive, active)).values())
    still = open_flows(spark, checkpoint)
    return spark.read.schema(still.schema).parquet(sink).unionByName(still), late


class CacheOverflow(Exception):
    """A cache is full of flows that may all still be extended."""


class _LimitedCache(StatefulProcessor):
    """One cache: a map of open flows, and the account of its size and its time (the largest end seen)."""

    def __init__(self, limit: int, inactive: int, active: int):
        self.limit, self.inactive, self.active = limit, inactive, active

    def init(self, handle) -> None:
        key = "a_ip string, b_ip string, a_port int, b_port int, proto int"
        self.flows = handle.getMapState("flows", key, _STATE)
        self.account = handle.getValueState("account", "size long, now long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        size, now = self.account.get() or (0, 0)
        touched: dict[tuple, list] = {}
        done: list[tuple] = []

        def close(at: tuple, row: list) -> None:
            done.append((*at, row[8], row[fold.START], row[fold.END], row[fold.SWAP], *row[fold.P0:fold.REVERSED]))

        for *at, start, end, swap, packets, octets, version in _in_arrival_order(rows, [*KEY, *_RECORD]):
            at, now = tuple(at), max(now, end)
            if at not in touched and self.flows.containsKey(at):
                touched[at] = list(self.flows.getValue(at))
            row = touched.get(at)
            if row is not None:
                if not fold.absorb(row, start, end, swap, packets, octets, self.inactive, self.active):
                    close(at, row)
                    touched[at] = [*fold.open_flow(start, end, swap, packets, octets), version]
                continue
            touched[at] = [*fold.open_flow(start, end, swap, packets, octets), version]
            size += 1
            if size >= self.limit:  # only now are old flows looked for
                for known, row in touched.items():
                    self.flows.updateValue(known, tuple(row))
                old = [(k, list(v)) for k, v in self.flows.iterator() if v[fold.END] < now - 1.5 * self.active]
                if not old:
                    raise CacheOverflow(f"a cache of {self.limit} flows is full of flows that may still be extended")
                for known, row in old:
                    close(tuple(known), row)
                    self.flows.removeKey(tuple(known))
                size -= len(old)
                touched.clear()
        for known, row in touched.items():
            self.flows.updateValue(known, tuple(row))
        self.account.update((size, now))
        yield pd.DataFrame(done, columns=_NAMES)


def run_limited_stream(records: DataFrame, sink: str, checkpoint: str, limit: int, caches: int = 1, inactive: int = INACTIVE, active: int = ACTIVE):
    """The flow cache with a size limit: keys are dealt over ``caches`` caches of at most ``limit`` flows each.

    Flows stay until another one takes their key or their cache is full; then all flows of the cache go whose end lies more
    than one and a half active timeouts before the largest end seen, and if there is none, the stream fails with
    ``CacheOverflow``. One cache is the single cache of a sequential profiler; more of them run in parallel, each with
    its own time. No row is late here. The state lives in RocksDB, so a cache need not fit in memory.
    """
    spark = records.sparkSession
    rows = keyed_records(records).select(*KEY, "arrival_seq", *_RECORD).withColumn("cache", F.pmod(F.xxhash64(*KEY), F.lit(caches)))
    flows = rows.groupBy("cache").transformWithStateInPandas(_LimitedCache(limit, inactive, active), _OUT, "append", "none")
    setting, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, provider)  # the query keeps the settings it was started with
    try:
        return (
            _as_profile(flows).writeStream.format("parquet").outputMode("append")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def limited_open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Profile rows of the flows that the caches of a stopped limited stream hold."""
    kept = state_rows(spark, checkpoint, variable="flows").select("user_map_key.*", "user_map_value.*")
    return _as_profile(kept.withColumnsRenamed({"start": "start_time", "end": "end_time"}))
