"""Vector code compression: product codes learned by dual-tree Lloyd rounds in whole numbers.

Vectors are cut into parts; every part position has a codebook of its own. Blocks of vectors carry, per position, the
order of a balanced tree over their parts, made once. A round walks that tree against a tree over the codebook's entries:
bounds on the distance of two nodes rule entries out for a whole node, a node with one entry left is assigned by its
cached sum and count, and only points of undecided leaves are measured one by one. Bounds and distances are whole
numbers, so that pruning never changes a result; an entry goes only if it is farther than another one for every point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from biflux.llm.common import carried
from biflux.runtime import broadcast_if_small, durable
from biflux.schemas import FlowDataError

LEAF = 16
SALTS = 16


def halves(count: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Node boundaries of a balanced tree over ``count`` places, level by level."""
    levels = [np.array([0, count])]
    while np.diff(levels[-1]).max() > leaf:
        bounds = levels[-1]
        middle = (bounds[:-1] + bounds[1:] + 1) // 2
        levels.append(np.append(np.stack([bounds[:-1], middle], 1).ravel(), count))
    return levels


def tree_order(points: np.ndarray) -> np.ndarray:
    """Places of the points so that every node of ``halves`` is a run of them: each node is cut across its widest side."""
    order = np.arange(len(points))
    for bounds in halves(len(points))[:-1]:
        sorted_points, starts, sizes = points[order], bounds[:-1], np.diff(bounds)
        widest = (np.maximum.reduceat(sorted_points, starts) - np.minimum.reduceat(sorted_points, starts)).argmax(1)
        node = np.repeat(np.arange(len(starts)), sizes)
        order = order[np.lexsort((sorted_points[np.arange(len(order)), widest[node]], node))]
    return order


class EntryTree:
    """Boxes over the entries of one codebook; node 0 is the root, ``entry`` is -1 for inner nodes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        low, high, children, single = [], [], [], []

        def grow(members: np.ndarray) -> int:
            at, points = len(low), entries[members]
            low.append(points.min(0))
            high.append(points.max(0))
            children.append((-1, -1))
            single.append(int(members[0]) if len(members) == 1 else -1)
            if len(members) > 1:
                cut = members[np.argsort(points[:, (high[at] - low[at]).argmax()], kind="stable")]
                children[at] = (grow(cut[: len(cut) // 2]), grow(cut[len(cut) // 2:]))
            return at

        grow(np.arange(len(entries)))
        self.low, self.high = np.array(low), np.array(high)
        self.children, self.entry = np.array(children), np.array(single)
        self.extent = ((self.high - self.low) ** 2).sum(1)


def assign(points: np.ndarray, tree: EntryTree, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(count, sum) per entry over points in tree order, and how many were measured; fills ``codes`` where given.

    The nearest entry wins, of equal ones the first.
    """
    size = len(tree.entries)
    counts, sums, measured = np.zeros(size, np.int64), np.zeros((size, points.shape[1]), np.int64), 0
    levels = halves(len(points))
    q = e = np.zeros(1, np.int64)
    for depth, bounds in enumerate(levels):
        starts, sizes = bounds[:-1], np.diff(bounds)
        low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        extent, last = ((high - low) ** 2).sum(1), depth == len(levels) - 1
        while True:
            left, right = tree.low[e] - high[q], low[q] - tree.high[e]
            near = (np.maximum(np.maximum(left, right), 0) ** 2).sum(1)
            far = (np.maximum(-left, -right) ** 2).sum(1)
            best = np.full(len(starts), np.iinfo(np.int64).max)
            np.minimum.at(best, q, far)
            stays = near <= best[q]
            q, e = q[stays], e[stays]
            wide = (tree.entry[e] < 0) & (last | (tree.extent[e] > extent[q]))
            if not wide.any():
                break
            q, e = np.concatenate([q[~wide], np.repeat(q[wide], 2)]), np.concatenate([e[~wide], tree.children[e[wide]].ravel()])
        left_over = np.bincount(q, minlength=len(starts))
        sure = (left_over[q] == 1) & (tree.entry[e] >= 0)
        if sure.any():  # cached sums assign whole nodes
            total = np.add.reduceat(points, starts)
            np.add.at(counts, tree.entry[e[sure]], sizes[q[sure]])
            np.add.at(sums, tree.entry[e[sure]], total[q[sure]])
            if codes is not None:
                for node, entry in zip(q[sure], tree.entry[e[sure]]):
                    codes[bounds[node]:bounds[node + 1]] = entry
            q, e = q[~sure], e[~sure]
        if not len(q):
            break
        if last:
            open_pairs = np.zeros((len(starts), size), bool)
            open_pairs[q, tree.entry[e]] = True
            node = np.repeat(np.arange(len(starts)), sizes)
            undecided = np.flatnonzero(open_pairs.any(1)[node])
            distance = np.full((len(undecided), size), np.iinfo(np.int64).max)
            for entry in range(size):
                rows = np.flatnonzero(open_pairs[node[undecided], entry])
                distance[rows, entry] = ((points[undecided[rows]] - tree.entries[entry]) ** 2).sum(1)
                measured += len(rows)
            chosen = distance.argmin(1)
            counts += np.bincount(chosen, minlength=size)
            np.add.at(sums, chosen, points[undecided])
            if codes is not None:
                codes[undecided] = chosen
        else:  # down the tree of points: both halves keep the entries that are left
            q, e = np.concatenate([2 * q, 2 * q + 1]), np.concatenate([e, e])
    return counts, sums, measured


def _usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def _blocks(rows: DataFrame, parts: int, width: int, carry: str) -> DataFrame:
    """Blocks of some 4 million components: whole numbers, the tree order per part position, and the carried columns."""
    length, limit = width // parts, int((2.0 ** 61 / (width // parts)) ** 0.5)
    most = max(256, 4_000_000 // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                whole = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                if np.abs(whole).max() >= min(limit, 1 << 31):
                    raise ValueError(f"components from {limit} / 4096 on are beyond exact whole numbers")
                order = np.stack([tree_order(whole[:, p * length:(p + 1) * length]) for p in range(parts)])
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                    pa.array([whole.astype("<i4").tobytes()]), pa.array([order.astype("<i4").tobytes()])], names=["carried", "whole", "places"])

    return rows.mapInArrow(run, f"carried array<{carry}>, whole binary, places binary")


def _opened(batch: pa.RecordBatch, k: int, parts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(batch.column("whole")[k].as_py(), "<i4").reshape(-1, width).astype(np.int64)
    return whole, np.frombuffer(batch.column("places")[k].as_py(), "<i4").reshape(parts, -1)


def _round(blocks: DataFrame, codebooks: np.ndarray) -> list[Row]:
    """Sum and count per (part, entry, component), summed up by Spark: as many rows as the codebooks have numbers."""
    parts, size, length = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(book) for book in codebooks]
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, length), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                whole, places = _opened(batch, k, parts, parts * length)
                for p in range(parts):
                    n, s, _ = assign(whole[places[p], p * length:(p + 1) * length], trees[p])
                    counts[p] += n
                    sums[p] += s
        at = np.indices(sums.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, at), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), length))], names=["p", "e", "c", "total", "n"])

    found = blocks.select("whole", "places").mapInArrow(run, "p bigint, e bigint, c bigint, total bigint, n bigint")
    return found.groupBy("p", "e", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id",
             vector_col: str = "embedding", carry: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """((id, code, error, carried) of every usable row, codebooks as an array of part, entry, component).

    A component x becomes floor(scale * x); codebooks start as the parts of the rows with the least ids (null ids last,
    equal ids by vector). Every round assigns every part of every row and moves each entry to the floored mean of its
    parts; an entry without parts stays. ``code`` has one number per part in two (or as many as needed) hex digits,
    ``error`` is the squared distance in whole numbers.

    Not usable, and left out: a null or empty vector, one with a null, NaN or infinite component, and one whose length
    is not that of the row with the least id. That length must be a multiple of ``parts``. Repeated rows count as rows
    of their own; with fewer rows than ``entries``, codebooks are smaller; an empty table gives no rows. Components must
    stay below sqrt(2**61 / part length) / scale (32 768 for 256 components), so that 64-bit sums are exact; others are
    an error. No key is shuffled: blocks are read in every round, the driver sees sums of the codebooks' size.
    """
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.where(_usable(F.col(f"`{vector_col}`"))).select(
        F.struct(F.col(f"`{id_col}`").alias("id"), carried(carry)).alias("carried"), vector.alias("whole"))
    first = rows.orderBy(F.col("carried.id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    kind = rows.schema["carried"].dataType
    shape = f"`{id_col}` {kind['id'].dataType.simpleString()}, code string, error bigint, carried {kind['carried'].dataType.simpleString()}"
    if not first:
        return vectors.sparkSession.createDataFrame([], shape), np.zeros((parts, 0, 0), np.int64)
    width = len(first[0].whole)
    if width % parts:
        raise FlowDataError(f"vectors of {width} components have no {parts} equal parts")
    length = width // parts
    rows = rows.where(F.size("whole") == width)
    start = np.array([r.whole for r in first if len(r.whole) == width], np.int64)
    codebooks = np.ascontiguousarray(start.reshape(-1, parts, length).transpose(1, 0, 2))
    size, digits = codebooks.shape[1], max(2, len(f"{codebooks.shape[1] - 1:x}"))
    blocks = durable(_blocks(rows, parts, width, kind.simpleString()))
    for _ in range(rounds):
        for r in _round(blocks, codebooks):
            if r.n:
                codebooks[r.p, r.e, r.c] = r.total // r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(book) for book in codebooks]
        names = np.array([f"{k:0{digits}x}" for k in range(size)], dtype=object)
        for batch in batches:
            for k in range(batch.num_rows):
                whole, places = _opened(batch, k, parts, width)
                codes, error = np.full(len(whole), "", dtype=object), np.zeros(len(whole), np.int64)
                for p in range(parts):
                    points, found = whole[places[p], p * length:(p + 1) * length], np.empty(len(whole), np.int64)
                    assign(points, trees[p], found)
                    back = np.empty(len(whole), np.int64)
                    back[places[p]] = found
                    codes += names[back]
                    error[places[p]] += ((points - trees[p].entries[found]) ** 2).sum(1)
                kept = batch.column("carried")[k].values
                yield pa.RecordBatch.from_arrays(
                    [kept.field("id"), pa.array(codes.tolist(), pa.string()), pa.array(error), kept.field("carried")], names=[id_col, "code", "error", "carried"])

    return blocks.mapInArrow(run, shape), codebooks


def digest(codebooks: np.ndarray) -> str:
    """sha256 of all numbers by part, entry and component, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_group_error(coded: DataFrame, group: Column) -> DataFrame:
    """Adds ``group_error``: the errors of all rows of a group, nulls together.

    Sums are pre-aggregated; their table is broadcast if it is counted to be small. Beyond that it is joined by (group,
    salt), so that a group of any size spreads over 16 tasks and more by the engine's own splitting.
    """
    rows = coded.withColumn("_group", group)
    sums = rows.groupBy("_group").agg(F.sum("error").alias("group_error"))
    small = broadcast_if_small(sums)
    if small is sums:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)))
        small = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        match = rows["_group"].eqNullSafe(small["_group"]) & (rows["_salt"] == small["_salt"])
    else:
        match = rows["_group"].eqNullSafe(small["_group"])
    return rows.join(small, match).select(*[rows[c] for c in coded.columns], "group_error")
