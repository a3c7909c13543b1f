"""Build biflow profiles from raw uniflow records.

Whether a record extends the open flow of its key depends on the records before it, so each key is a fold in arrival
order. The fold runs over sorted partitions (``mapInPandas``): a task streams through many keys and holds one open flow,
never a group.

A key with an outstanding share of the rows would keep one task busy. Such keys are cut into pieces of equal numbers of
rows by arrival. All pieces are folded in parallel, first as if nothing were open before them. A piece is folded again only if the piece
before it turns out to leave something else behind. The rounds end when no piece changes, which is exactly the result
of the sequential fold.
"""

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Row, Window, functions as F

from biflux.functions.keys import CANON, l3_from_text, with_canonical_key, zero_ports
from biflux.operators import fold
from biflux.runtime import durable
from biflux.schemas import PROFILE_COLUMNS
from biflux.skew import heavy_keys, keyed_scan, split_heavy

INACTIVE, ACTIVE = 30_000, 300_000
KEY = [*CANON, "proto"]
PIECES = 4096
_SLICE = 1_000_000
_GROUP = [*KEY, "piece"]
_ROW_COLUMNS = [*KEY, "arrival_seq", "start_time", "end_time", "swap", "packets", "bytes", "l3_proto"]
_STATE = "e_long boolean, e_start long, e_end long, e_swap boolean, e_reversed boolean"
_STATE_COLUMNS = ["e_long", "e_start", "e_end", "e_swap", "e_reversed"]
_PARTIAL = (
    "a_ip string, b_ip string, a_port int, b_port int, proto int, piece long, l3_proto int, no long,"
    " continued boolean, start_time long, end_time long, swap boolean, p0 long, b0 long, p1 long, b1 long"
)
_EXIT = f"a_ip string, b_ip string, a_port int, b_port int, proto int, piece long, {_STATE}"


def to_ms(raw: DataFrame) -> DataFrame:
    """Float seconds -> whole ms, relative to the first record.

    The time base is the first non-zero start in arrival order; records before it start at zero and keep their time.
    """
    timed = raw.withColumns({
        "start_time": (F.col("start_time") * 1000).cast("long"), "duration": (F.col("duration") * 1000).cast("long"),
    })
    base = timed.where(F.col("start_time") != 0).agg(
        F.min(F.struct("arrival_seq", F.col("start_time").alias("zero")))).scalar()
    shift = F.when(F.col("arrival_seq") >= base["arrival_seq"], base["zero"]).otherwise(0)
    return timed.withColumn("start_time", F.col("start_time") - F.coalesce(shift, F.lit(0))).withColumn(
        "end_time", F.col("start_time") + F.col("duration")).drop("duration")


def keyed_records(records: DataFrame) -> DataFrame:
    """Ports only for TCP and UDP, address version, canonical key without a tie on the port."""
    cleaned = records.withColumns({
        "src_port": zero_ports("proto", "src_port"), "dst_port": zero_ports("proto", "dst_port"),
        "l3_proto": l3_from_text(F.col("src_ip")),
    })
    return with_canonical_key(cleaned)


def _stream(inactive: int, active: int, exits: bool):
    """Fold sorted batches; yields partial flows, or the decision state each piece leaves behind."""
    names = [c.strip().split()[0] for c in (_EXIT if exits else _PARTIAL).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, flow, head, no, continued, started = None, None, None, 0, False, False

        def partial():
            return (*group, head, no, continued, flow[fold.START], flow[fold.END], None if continued else flow[fold.SWAP],
                    *flow[fold.P0:fold.REVERSED])

        def left_behind():
            return (*group, *fold.decision_state(flow, inactive, active))

        for batch in batches:
            out = []
            columns = [batch[c].tolist() for c in _GROUP]
            values = [batch[c].tolist() for c in ("start_time", "end_time", "swap", "packets", "bytes", "l3_proto")]
            entries = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in _STATE_COLUMNS]
            for now, record, entry in zip(zip(*columns), zip(*values), zip(*entries)):
                start, end, swap, packets, octets, l3 = record
                if now != group:
                    if group is not None:
                        if exits:
                            out.append(left_behind())
                        elif started:
                            out.append(partial())
                    group, head, no, continued, started = now, l3, 0, entry[0] is not None, False
                    flow = fold.resume(*entry, inactive, active) if continued else None
                if flow is not None and fold.absorb(flow, start, end, swap, packets, octets, inactive, active):
                    started = True
                    continue
                if flow is not None and started and not exits:
                    out.append(partial())
                no, continued, started, head = no + 1, False, True, l3
                flow = fold.open_flow(start, end, swap, packets, octets)
            if out:
                yield pd.DataFrame(out, columns=names)
        if group is not None:
            if exits:
                yield pd.DataFrame([left_behind()], columns=names)
            elif started:
                yield pd.DataFrame([partial()], columns=names)

    return run


def _folded(rows: DataFrame, entries: DataFrame | None, inactive: int, active: int, exits: bool) -> DataFrame:
    if entries is None:
        fields = [f.split() for f in _STATE.split(", ")]
        rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in fields})
    else:
        rows = rows.join(entries, _GROUP, "left")
    parted = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "arrival_seq")
    return parted.mapInPandas(_stream(inactive, active, exits), _EXIT if exits else _PARTIAL)


def _entry_states(rows: DataFrame, inactive: int, active: int) -> DataFrame:
    """Decision state at the start of every piece but the first, by repeated folding until nothing changes."""
    exits = durable(_folded(rows, None, inactive, active, True))
    chain = Window.partitionBy(*KEY).orderBy("piece")
    entries = None
    while True:
        found = durable(exits.select(
            *_GROUP, *[F.lag(c).over(chain).alias(c) for c in _STATE_COLUMNS]).where(F.col("piece") > 0))
        if entries is None:
            changed = found
        else:
            same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in _STATE_COLUMNS])
            changed = found.alias("n").join(entries.alias("o"), _GROUP).where(~same).select(*_GROUP, *[f"n.{c}" for c in _STATE_COLUMNS])
        changed = durable(changed)
        if changed.isEmpty():
            return found
        again = _folded(rows.join(changed.select(*_GROUP), _GROUP, "left_semi"), changed, inactive, active, True)
        exits = durable(exits.join(changed, _GROUP, "left_anti").unionByName(again))
        entries = found


def _joined_pieces(partials: DataFrame) -> DataFrame:
    """Attach continued parts to the flow they belong to."""
    opened = partials.groupBy(*_GROUP).agg(F.max("no").alias("opened"))
    before = Window.partitionBy(*KEY).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = opened.select(*_GROUP, F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("before"))
    numbered = partials.join(offsets, _GROUP).withColumn("flow_no", F.col("before") + F.col("no"))
    founder = ~F.col("continued")
    return numbered.groupBy(*KEY, "flow_no").agg(
        F.min(F.when(founder, F.col("l3_proto"))).alias("l3_proto"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.bool_or(F.when(founder, F.col("swap"))).alias("swap"),
        *[F.sum(c).alias(c) for c in ("p0", "b0", "p1", "b1")])


def build_profile(
    records: DataFrame,
    inactive: int = INACTIVE,
    active: int = ACTIVE,
    heavy: list[Row] | None = None,
    pieces: int = PIECES,
) -> DataFrame:
    """Uniflow records in ms with ``arrival_seq`` -> biflow profile in the direction of the first record."""
    rows = keyed_records(records).select(*_ROW_COLUMNS)
    heavy = heavy_keys(rows, KEY) if heavy is None else heavy
    if not heavy:
        return _as_profile(_folded(rows.withColumn("piece", F.lit(0).cast("long")), None, inactive, active, False))
    cold, hot = split_heavy(rows, KEY, heavy)
    # Pieces hold equal numbers of a key's rows, wherever in the input these lie.
    slices = {"_slice": F.floor(F.col("arrival_seq") / _SLICE)}
    ranked = durable(keyed_scan(hot, KEY, ["arrival_seq"], slices, total={"rank": F.lit(1).cast("long")}, heavy=heavy))
    size = max(1, -(-ranked.agg(F.max("rank")).first()[0] // pieces))
    hot = ranked.withColumn("piece", F.floor(F.col("rank") / size).cast("long")).drop("rank")
    entries = _entry_states(hot, inactive, active)
    joined = _joined_pieces(_folded(hot, entries, inactive, active, False))
    whole = _folded(cold.withColumn("piece", F.lit(0).cast("long")), None, inactive, active, False)
    return _as_profile(whole).unionByName(_as_profile(joined))


def _as_profile(flows: DataFrame) -> DataFrame:
    swap = F.col("swap")

    def side(own: str, other: str):
        return F.when(swap, F.col(other)).otherwise(F.col(own))

    return flows.select(
        "start_time", "end_time", "l3_proto", F.col("proto").alias("l4_proto"),
        side("a_port", "b_port").alias("src_port"), side("b_port", "a_port").alias("dst_port"),
        side("p0", "p1").alias("packets"), side("b0", "b1").alias("bytes"),
        side("p1", "p0").alias("packets_rev"), side("b1", "b0").alias("bytes_rev"),
    ).select(*PROFILE_COLUMNS)
