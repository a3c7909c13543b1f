"""One-to-one match of two flow tables whose rows agree only within a relative tolerance.

Rows that agree share the protocols and every port that no report leaves open, so a match never leaves such a group. Groups of
bounded size are streamed sorted and solved where they lie, many at a time, by shortest augmenting paths.

Values that agree within the tolerance lie in the same or in neighbouring cells of a logarithmic grid. In larger groups, rows of
one cell in all measures agree with each other whoever they are, so they are paired by their number in the cell: one shuffle,
and nothing is paired with everything. Only rows that this leaves on both sides are searched: trees of alternating paths grow
from all unmatched rows at once, a step is one join of the trees' outermost rows, and each tree that reaches an unmatched
row of the other side is turned over. When no tree reaches one, no larger match exists.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from biflux.runtime import broadcast_if_small, durable
from biflux.skew import keyed_scan

MEASURES = ("start_time", "end_time", "packets", "bytes", "packets_rev", "bytes_rev")
SAME = ("l3_proto", "l4_proto")
PORTS = ("src_port", "dst_port")
#: Measures whose cells are join keys of the search; the others are tested.
BANDED = ("bytes", "bytes_rev", "start_time")
#: Possible pairs of a group that one task solves, and rows (of many groups) that it holds at once besides the last group.
CROWD, CHUNK = 1 << 22, 50_000


def close(a: Column, b: Column, tolerance: float) -> Column:
    """The difference is at most the tolerance of the larger absolute value; zero is only close to zero."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def cell(value: Column, tolerance: float) -> Column:
    """Cell of the grid; close values differ by one cell at most. Zero and negative values have cells far from the others."""
    step = -math.log(1 - tolerance) * 1.000001
    place = F.floor(F.log(F.abs(value.cast("double"))) / step)
    return F.when(value > 0, place).when(value < 0, place + 10_000_000).otherwise(-10_000_000).cast("long")


def _agrees(p: str, r: str, tolerance: float) -> Column:
    tests = [close(F.col(f"{p}.{m}"), F.col(f"{r}.{m}"), tolerance) for m in MEASURES]
    tests += [(F.col(f"{r}.{c}") == 0) | (F.col(f"{r}.{c}") == F.col(f"{p}.{c}")) for c in PORTS]
    return reduce(Column.__and__, tests)


def _slim(rows: DataFrame, id_name: str) -> DataFrame:
    """Rows with an id and no null in what is compared."""
    return rows.select(F.col(id_name).alias("id"), *SAME, *PORTS, *MEASURES).dropna()


def _numbered_pairs(left: DataFrame, right: DataFrame, zero: tuple[bool, bool], tolerance: float) -> DataFrame:
    """Pairs of rows in one cell, n-th with n-th; ``zero`` says which ports the right side leaves open."""
    for c, is_zero in zip(PORTS, zero):
        right = right.where((F.col(c) == 0) if is_zero else (F.col(c) != 0))
    keys = [*SAME, *[c for c, is_zero in zip(PORTS, zero) if not is_zero], *[f"c_{m}" for m in MEASURES]]

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumns({f"c_{m}": cell(F.col(m), tolerance) for m in MEASURES})
        rows = keyed_scan(rows, keys, ["id"], {"_piece": F.floor(F.col("id") / 65536)}, total={"turn": F.lit(1).cast("long")})
        return rows.select(*keys, "turn", F.struct("id", *PORTS, *MEASURES).alias(name))

    met = numbered(left, "p").join(numbered(right, "r"), [*keys, "turn"])
    return met.where(_agrees("p", "r", tolerance)).select(F.col("p.id").alias("p"), F.col("r.id").alias("r"))


def _reached(front: DataFrame, right: DataFrame, patterns: list[tuple], tolerance: float) -> DataFrame:
    """Per row of the right side one agreeing row of the front, with the root of its tree. ``front``: root and the row.

    Ports are join keys too: a row of the front comes once per way in which ports are left open (``patterns``).
    """
    ports = F.array_distinct(F.array(*[F.struct(*[
        (F.lit(0) if is_zero else F.col(f"p.{c}")).cast("long").alias(f"k_{c}") for c, is_zero in zip(PORTS, zero)]) for zero in patterns]))
    bands = front.select("root", "p", F.explode(ports).alias("k")).select("root", "p", "k.*")
    for m in BANDED:
        c = cell(F.col(f"p.{m}"), tolerance)
        bands = bands.withColumn(f"c_{m}", F.explode(F.array(c - 1, c, c + 1)))
    places = [*[f"k_{c}" for c in PORTS], *[f"c_{m}" for m in BANDED]]
    bands = bands.select("root", "p", *[F.col(f"p.{c}").alias(c) for c in SAME], *places)
    cells = right.select(F.struct(*right.columns).alias("r"), *SAME, *[F.col(c).cast("long").alias(f"k_{c}") for c in PORTS],
                         *[cell(F.col(m), tolerance).alias(f"c_{m}") for m in BANDED])
    met = bands.join(cells, [*SAME, *places]).where(_agrees("p", "r", tolerance))
    return met.groupBy(F.col("r.id").alias("r")).agg(F.min(F.struct(F.col("root"), F.col("p.id").alias("p"))).alias("by")).select("r", "by.root", "by.p")


def _grown(left: DataFrame, right: DataFrame, pairs: DataFrame, patterns: list[tuple], tolerance: float) -> DataFrame | None:
    """The match with one more pair per tree that reaches an unmatched row, or None if none does."""
    whole = F.struct(*left.columns)
    front = left.join(pairs, left["id"] == pairs["p"], "left_anti").select(F.col("id").alias("root"), whole.alias("p"))
    spare = durable(right.join(pairs, right["id"] == pairs["r"], "left_anti"))
    if spare.isEmpty():
        return None
    open_rows, levels = right, []
    while True:
        found = durable(_reached(front, open_rows, patterns, tolerance))
        if found.isEmpty():
            return None
        levels.append(found)
        ends = durable(found.join(spare.select(F.col("id").alias("r")), "r").groupBy("root").agg(F.min("r").alias("r")))
        if not ends.isEmpty():
            break
        open_rows = durable(open_rows.join(found, open_rows["id"] == found["r"], "left_anti").select(right.columns))
        front = found.select("root", "r").join(pairs, "r").join(left, F.col("p") == left["id"]).select("root", whole.alias("p"))
    # Trees share no row, so the paths from the ends back to the roots do not meet.
    made, at = None, ends.select("r")
    for found in reversed(levels):
        step = durable(at.join(found, "r").select("p", "r"))
        made = step if made is None else made.unionByName(step)
        at = step.select("p").join(pairs, "p").select("r")
    kept = pairs.join(made.select("p"), "p", "left_anti")
    return durable(kept.unionByName(made))


def _edges(left: dict, right: dict, tolerance: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Agreeing pairs of rows, groups in ``at``: by group and bytes sorted, then tested, ``most`` candidates at a time."""
    order = np.lexsort((right["bytes"], right["at"]))
    values = np.unique(right["bytes"])
    place = right["at"][order] * (len(values) + 1) + np.searchsorted(values, right["bytes"][order])
    own = left["bytes"]
    if tolerance < 1:
        ends = np.sort(np.stack([own * (1 - tolerance) * (1 - 1e-9), own / (1 - tolerance) * (1 + 1e-9)]), axis=0)
    else:
        ends = np.stack([np.full(len(own), -np.inf), np.full(len(own), np.inf)])
    base = left["at"] * (len(values) + 1)
    first = np.searchsorted(place, base + np.searchsorted(values, ends[0]))
    size = np.searchsorted(place, base + np.searchsorted(values, ends[1], side="right")) - first
    total = np.concatenate([[0], np.cumsum(size)])
    begin = 0
    while begin < len(own):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, side="right")) - 1)
        n = size[begin:end]
        p = np.repeat(np.arange(begin, end), n)
        r = order[np.arange(len(p)) - np.repeat(total[begin:end] - total[begin], n) + np.repeat(first[begin:end], n)]
        for c in PORTS:
            keep = (right[c][r] == 0) | (right[c][r] == left[c][p])
            p, r = p[keep], r[keep]
        for m in MEASURES:
            x, y = left[m][p], right[m][r]
            keep = np.abs(x - y) <= tolerance * np.maximum(np.abs(x), np.abs(y))
            p, r = p[keep], r[keep]
        yield p, r
        begin = end


def largest_match(first: list[int], to: list[int], columns: int) -> list[int]:
    """Column of each row (-1: none) in a largest match; row ``k`` may have ``to[first[k]:first[k + 1]]`` (Hopcroft and Karp)."""
    rows = len(first) - 1
    column_of, row_of = [-1] * rows, [-1] * columns
    for k in range(rows):
        for c in to[first[k]:first[k + 1]]:
            if row_of[c] < 0:
                row_of[c], column_of[k] = k, c
                break
    while True:
        roots = [k for k in range(rows) if column_of[k] < 0 and first[k] < first[k + 1]]
        depth = dict.fromkeys(roots, 0)
        front, found = roots, False
        while front and not found:
            later = []
            for k in front:
                for c in to[first[k]:first[k + 1]]:
                    other = row_of[c]
                    if other < 0:
                        found = True
                    elif other not in depth:
                        depth[other] = depth[k] + 1
                        later.append(other)
            front = later
        if not found:
            return column_of
        at = {}
        for root in roots:
            path = [root]
            while path:
                k = path[-1]
                turn = at.get(k, first[k])
                if turn == first[k + 1]:
                    depth[k] = -1
                    path.pop()
                    continue
                at[k] = turn + 1
                c = to[turn]
                other = row_of[c]
                if other < 0:
                    for k in reversed(path):
                        column_of[k], row_of[c], c = c, k, column_of[k]
                    break
                if depth.get(other, -1) == depth[k] + 1:
                    path.append(other)


def _solved(table: pa.Table, groups: np.ndarray, tolerance: float) -> pa.RecordBatch:
    """Pairs of whole groups of rows; ``groups`` has the group of each row."""
    sides = table.column("is_right").to_numpy()
    values = {c: table.column(c).to_numpy() for c in ("id", *PORTS, *MEASURES)} | {"at": groups}
    left, right = ({c: v[sides == s] for c, v in values.items()} for s in (0, 1))
    parts = [*_edges(left, right, tolerance)] if len(left["id"]) and len(right["id"]) else []
    p, r = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
    first = np.concatenate([[0], np.cumsum(np.bincount(p, minlength=len(left["id"])))])
    column = np.array(largest_match(first.tolist(), r.tolist(), len(right["id"])), np.int64)
    has = column >= 0
    return pa.RecordBatch.from_arrays([pa.array(left["id"][has]), pa.array(right["id"][column[has]])], names=["p", "r"])


def _solve_groups(batches: Iterator[pa.RecordBatch], tolerance: float, chunk: int) -> Iterator[pa.RecordBatch]:
    """Groups one after the other (rows sorted by ``group_*``); as many at a time as ``chunk`` rows hold."""
    held, size = [], 0

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for name in table.column_names:
            if name.startswith("group_"):
                column = table.column(name).to_numpy()
                new[1:] |= column[1:] != column[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= chunk:
            table = pa.Table.from_batches(held)
            groups = numbered(table)
            whole = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if whole:
                yield _solved(table.slice(0, whole), groups[:whole], tolerance)
            held, size = table.slice(whole).to_batches(), 0 if whole else size // 2
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield _solved(table, numbered(table), tolerance)


def _local_pairs(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    names = {c: f"group_{k}" for k, c in enumerate(keys)}
    rows = rows.select(*[F.col(c).cast("long").alias(n) for c, n in names.items()], "is_right", F.col("id").cast("long").alias("id"),
                       *[F.col(c).cast("long").alias(c) for c in PORTS], *[F.col(m).cast("double").alias(m) for m in MEASURES])
    dealt = rows.repartition(F.xxhash64(*names.values())).sortWithinPartitions(*names.values())
    chunk = CHUNK
    return dealt.mapInArrow(lambda batches: _solve_groups(batches, tolerance, chunk), "p long, r long")


def _searched_pairs(left: DataFrame, right: DataFrame, patterns: list[tuple], tolerance: float) -> DataFrame:
    """A largest match of groups of any size: by numbers in cells, then by trees."""
    pairs, rest, spare = None, left, right
    for zero in patterns:
        found = durable(_numbered_pairs(rest, spare, zero, tolerance))
        pairs = found if pairs is None else pairs.unionByName(found)
        rest = rest.join(found, rest["id"] == found["p"], "left_anti")
        spare = spare.join(found, spare["id"] == found["r"], "left_anti")
    pairs = durable(pairs)
    while (grown := _grown(left, right, pairs, patterns, tolerance)) is not None:
        pairs = grown
    return pairs


def tolerance_match(profile: DataFrame, report: DataFrame, tolerance: float = 0.2, profile_id: str = "flow_id", report_id: str = "report_id") -> DataFrame:
    """A largest one-to-one match: ``profile_id, report_id``; rows without a partner come with a null on the other side.

    Both tables have an integer id, protocols, ports, times, packets and bytes per direction. Rows agree if protocols are
    equal, each port of the report is 0 or equal, and all six measures are close. A row with a null in any of these has
    no partner; repeated rows each need one of their own. Which rows stay alone is not unique, their number is.
    """
    left, right = durable(_slim(profile, profile_id)), durable(_slim(report, report_id))
    patterns = sorted(tuple(r) for r in right.select(*[(F.col(c) == 0).alias(c) for c in PORTS]).distinct().collect())  # at most four
    pairs = left.select(F.col("id").alias("p"), F.col("id").alias("r")).limit(0)
    if patterns:
        keys = [*SAME, *[c for c, zeroes in zip(PORTS, zip(*patterns)) if not any(zeroes)]]
        sided = left.select("*", F.lit(0).alias("is_right")).unionByName(right.select("*", F.lit(1).alias("is_right")))
        sizes = sided.groupBy(*keys).agg(F.count_if(F.col("is_right") == 0).alias("n0"), F.count_if(F.col("is_right") == 1).alias("n1"))
        # Beside groups with too many pairs, long ones of one side are kept out of the tasks; they have no pairs.
        large = durable(sizes.where((F.col("n0") * F.col("n1") > CROWD) | (F.col("n0") + F.col("n1") > CROWD)))
        if large.isEmpty():
            pairs = durable(_local_pairs(sided, keys, tolerance))
        else:
            known = broadcast_if_small(large)
            pairs = durable(_local_pairs(sided.join(known, keys, "left_anti"), keys, tolerance))
            crowded = broadcast_if_small(large.where("n0 > 0 AND n1 > 0"))
            parts = [durable(rows.join(crowded, keys, "left_semi").select(rows.columns)) for rows in (left, right)]
            pairs = pairs.unionByName(_searched_pairs(*parts, patterns, tolerance))
    named = pairs.select(F.col("p").alias(profile_id), F.col("r").alias(report_id))
    lone = [
        profile.select(profile_id).join(named, profile_id, "left_anti").withColumn(report_id, F.lit(None).cast("long")),
        report.select(report_id).join(named, report_id, "left_anti").withColumn(profile_id, F.lit(None).cast("long"))]
    return named.unionByName(lone[0]).unionByName(lone[1])
