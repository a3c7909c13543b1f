"""Exact Jaccard join of word shingle sets as a join in a metric space, and the components of its links.

The Jaccard distance is a metric, but nearly all documents are at distance one from each other, so pivots drawn from
them would make regions that all overlap. The first pivots are therefore single shingles: in a fixed order of all
shingles two sets within the radius share one among their first |A| - ceil(t |A|) + 1, so a document is replicated to
the regions of exactly these shingles. Inside the regions documents are pivots: each document goes to the Voronoi cell
of its most central neighbour, measured exactly. Regions whose members are not one component yet are joined
recursively: members outside the component of the region's pivot become pivots in turn, in growing steps, and meet the
members that the triangle inequality leaves within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from biflux.llm.common import utf8
from biflux.runtime import broadcast_if_small, durable

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.uint64(1 << 63)
#: Shingles that lie last in the order; more would still be right, only with larger regions.
COMMON = 65_536
#: Slots of the counts that tell how far two sets are apart at least.
SLOTS = 128


def shingles(text: bytes, length: int) -> np.ndarray:
    """Sorted distinct 63-bit codes of the windows of ``length`` lower-cased words; fewer words are one window.

    The upper six bits say how short a window is: windows of many letters are rarely shared by chance and come first in
    the order of all shingles. The other bits are a hash.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - length + 1)
    sizes = np.cumsum([0, *map(len, words)])
    if len(words) < length:
        mixed = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        letters = sizes[-1:]
    else:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        mixed = h[:n].copy()
        for k in range(1, length):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _M1 + h[k:k + n]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _M2
        mixed ^= mixed >> np.uint64(31)
        letters = sizes[length:] - sizes[:n]
    short = (63 - np.minimum(letters, 63)).astype(np.uint64)
    return np.unique((short << np.uint64(57)) | (mixed >> np.uint64(7)))


def slot_counts(found: np.ndarray) -> np.ndarray:
    """Shingles by the low bits of their code, at most 127 each: two sets differ in no less than these counts do."""
    return np.minimum(np.bincount((found % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS), 127).astype(np.int8)


def _apart(x: str, y: str) -> Column:
    """How many shingles are in one of two sets alone, at least."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda total, d: total + d)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _common(rows: DataFrame, length: int, locally: int = 6, most: int = COMMON) -> np.ndarray:
    """The most frequent shingles, rarest first. Only their place in the order depends on them, not the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(v.as_py(), length) for v in batch.column(0)]
            found, n = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
            often = n >= locally
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], names=["s", "n"])

    top = rows.select("text").mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "s").limit(most)
    return np.array([r.s for r in top.collect()][::-1], np.int64).view(np.uint64)


def _sketches(rows: DataFrame, common, length: int, percent: int) -> DataFrame:
    """(id, row, n, cls, place, prefix, counts): the class is a hash of the set; prefix and counts come once per class and batch.

    The prefix has the places of its shingles in the order of all: the hash itself, or 2^63 and the rank of a common one.
    ``place`` is low for sets made of common shingles: such a set is likelier to be the centre of its neighbours.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = common.value
        order = np.argsort(ranked)
        sorted_common = ranked[order]
        for batch in batches:
            sizes, classes, places, prefixes, counts, seen = [], [], [], [], [], set()
            for value in batch.column(2):
                found = shingles(value.as_py(), length)
                n = len(found)
                cls = xxhash.xxh3_64_intdigest(found.tobytes(), seed=n) & 0x7FFFFFFFFFFFFFFF
                sizes.append(n)
                classes.append(cls)
                if not n or cls in seen:
                    places.append(0)
                    prefixes.append(None)
                    counts.append(None)
                    continue
                seen.add(cls)
                counts.append(slot_counts(found))
                at = np.minimum(np.searchsorted(sorted_common, found), max(0, len(sorted_common) - 1))
                often = sorted_common[at] == found if len(sorted_common) else np.zeros(n, bool)
                last = np.sort(order[at[often]]).astype(np.uint64) + _LAST if often.any() else found[:0]
                places.append(126 - int(126 * often.mean()))
                prefixes.append(np.concatenate([found[~often], last])[:prefix_size(n, percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(places, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int8()))], names=["id", "row", "n", "cls", "place", "prefix", "counts"])

    return rows.mapInArrow(run, f"id {kind}, row bigint, n bigint, cls bigint, place bigint, prefix array<bigint>, counts array<tinyint>")


def _sets(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(cls, data): the whole sets of the wanted classes, from one row of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [shingles(v.as_py(), length).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["cls", "data"])

    one = broadcast_if_small(wanted.select("cls", F.col("id").alias("id_"), F.col("row").alias("row_")), 1_000_000)
    return (
        rows.select("id", "row", "text").join(one, F.col("id").eqNullSafe(F.col("id_")) & (F.col("row") == F.col("row_"))).select("cls", "text")
        .mapInArrow(run, "cls bigint, data binary").dropDuplicates(["cls"]))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link by their prefixes alone.

    Of two sets, the one whose prefix ends first has all its shared prefix shingles in the other's prefix as well, so the
    intersection is at most the prefixes' own plus what either set has beyond the place where that prefix ends.
    """
    def most(p: np.ndarray, q: np.ndarray, m: int, n: int) -> int:
        if p[-1] > q[-1]:
            p, q, m, n = q, p, n, m
        both = len(np.intersect1d(p, q, assume_unique=True))
        return both + min(m - len(p), n - int(np.searchsorted(q, p[-1], side="right")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, pa_, pb = (batch.column(k) for k in range(6))
            keep = []
            for m, n, x, y in zip(na.to_pylist(), nb.to_pylist(), pa_, pb):
                p, q = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                keep.append(100 * min(m, n) >= percent * max(m, n) and most(p, q, m, n) * (100 + percent) >= percent * (m + n))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


def _measured(pairs: DataFrame, classes: DataFrame, rows: DataFrame, length: int, percent: int) -> DataFrame:
    """(a, b, both, linked) of the pairs (a, b) that can link: the exact size of the intersection of the whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                i = int((q[at] == p).sum())
                both.append(i)
                linked.append(100 * i >= percent * (len(p) + len(q) - i))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "both", "linked"])

    possible = durable(_possible(pairs, classes, percent))
    wanted = possible.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "id", "row"), "cls")
    sets = durable(_sets(rows, wanted, length))
    left = possible.join(sets.select(F.col("cls").alias("a"), F.col("data").alias("x")), "a")
    full = left.join(sets.select(F.col("cls").alias("b"), F.col("data").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, both bigint, linked boolean")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) names; the root is the least node of the component.

    Alternating large and small stars: each round hangs neighbours to the least neighbour, until nothing changes. Few
    edges are kept in few parts.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    parts = _parts(edges)
    edges = edges.coalesce(parts)
    least = F.min("v").over(Window.partitionBy("u"))
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        small = large.withColumn("m", least).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = durable(small.where("u <> v").coalesce(parts).distinct().coalesce(parts))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _parts(rows: DataFrame, each: int = 50_000) -> int:
    """Parts for a counted table: small ones need no more tasks (and files of shuffles) than their rows fill."""
    return max(8, rows.count() // each + 1)


def _without_copies(members: DataFrame) -> DataFrame:
    """Of regions with the same members the one of the least shingle: the members' first common shingle is among these.

    Long near copies share hundreds of shingles; pairs would be met once in each. Member sets are told by 128 bits.
    """
    marks = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    place = F.col("s").bitwiseXOR(F.lit(-(1 << 63)))  # signed order as unsigned: common shingles last
    kinds = members.groupBy("s").agg(F.count("*").alias("size"), *marks)
    least = kinds.groupBy("size", "mark1", "mark2").agg(F.min(place).alias("place"))
    return members.join(least.select(F.col("place").bitwiseXOR(F.lit(-(1 << 63))).alias("s")), "s")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, root, row) of every row of ``docs``.

    Rows link when 100 * intersection >= percent * union of their sets of ``length``-word shingles (told by 63-bit
    codes); ``component_id`` is the least id reachable, its own included. Rows of one component have one ``root``. A text
    without words has an empty set and links with nothing; null texts are empty; repeated rows are linked; a null id is
    never the least unless there is no other; an empty table gives no rows; other columns are ignored. ``row`` is a
    hash of the text.
    """
    text = utf8(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, length))
    sketch = durable(_sketches(rows, common, length, percent))
    # regions of shingles: (s, cls); only those with two classes matter
    spread = sketch.where(F.col("prefix").isNotNull()).select(F.posexplode("prefix").alias("pos", "s"), "cls", "place")
    spread = spread.select("s", "cls", (F.col("place") * (1 << 32) + F.col("pos")).alias("order")).repartition("s")
    spread = spread.select(
        "s", "cls", (F.shiftright("order", 32) * (1 << 56) + F.shiftright("cls", 7)).alias("pc"), F.col("order").bitwiseAND((1 << 32) - 1).alias("pos"))
    shared = spread.groupBy("s").agg(F.min("pc").alias("pivot"), F.max("pc").alias("other")).where("pivot <> other").select("s", "pivot")
    members = durable(spread.join(shared, "s").dropDuplicates(["s", "cls"]))
    met = members.groupBy("cls").agg(F.count("*").alias("met"))  # prefix shingles that any other class has in its prefix
    members = durable(_without_copies(members))
    # the Voronoi cell: the most central pivot among the regions of a class
    one_row = sketch.where("prefix is not null").groupBy("cls").agg(
        F.min("n").alias("n"), F.min(F.struct("id", "row")).alias("of"), F.min("prefix").alias("prefix"), F.min("counts").alias("counts"))
    classes = durable(
        members.groupBy("cls").agg(F.min("pc").alias("pc"), F.min("pivot").alias("home_pc")).join(one_row, "cls")
        .select("cls", "pc", "home_pc", "n", "of.id", "of.row", "prefix", "counts"))
    homes = classes.where("home_pc <> pc").select(F.col("cls").alias("b"), F.col("home_pc").alias("pc")).join(
        classes.select("pc", F.col("cls").alias("a")), "pc").select("a", "b")
    homes = durable(homes)
    measured = durable(_measured(homes, classes, rows, length, percent))
    compared, links = homes, measured.where("linked").select("a", "b")
    sizes = classes.select("cls", "n")
    # similarity to the pivot of the own cell, for the triangle inequality within a cell
    cells = measured.join(sizes.withColumnRenamed("cls", "a").withColumnRenamed("n", "na"), "a").join(
        sizes.withColumnRenamed("cls", "b").withColumnRenamed("n", "nb"), "b").select(
        F.col("b").alias("cls"), F.col("a").alias("cell"), (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("far"))
    known = durable(sizes.join(cells, "cls", "left").join(met, "cls").select("cls", "n", "met", F.coalesce("cell", "cls").alias("cell"), F.coalesce("far", F.lit(0.0)).alias("far")))
    members = members.join(known, "cls").withColumn("prev", F.lag("s").over(Window.partitionBy("cls").orderBy("pos"))).withColumns({
        "turn": F.row_number().over(Window.partitionBy("s").orderBy("pc", "cls")) - 1, "size": F.count("*").over(Window.partitionBy("s"))})
    members = durable(members.select("s", "cls", "turn", "size", "pos", "prev", "n", "met", "cell", "far"))
    largest = members.agg(F.coalesce(F.max("turn"), F.lit(0)).alias("m")).first().m
    roots = components(links)
    radius = 1 - percent / 100
    first, step = 0, 8
    while first <= largest:
        own = members.where(F.col("size") > first).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        mixed = own.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("turn", "root"))["root"].alias("main")).where("low <> high")
        open_ = durable(own.join(mixed.select("s", "main"), "s").join(classes.select("cls", "counts"), "cls"))
        pivots = open_.where((F.col("turn") >= first) & (F.col("turn") < first + step) & (F.col("root") != F.col("main")))
        x, y = pivots.alias("x"), open_.alias("y")
        # at their first common shingle, what lies before it in either prefix is not common
        most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        # and no more of their prefixes is common than what either shares with anyone
        beyond = F.greatest(*[F.ceil(percent * F.col(n) / 100) - 1 for n in ("x.n", "y.n")])
        most = F.least(most, F.least("x.met", "y.met") + beyond)
        # where they share the shingle before as well, they have met already
        fits = (
            F.coalesce(F.col("x.prev") != F.col("y.prev"), F.lit(True)) & (F.col("x.root") != F.col("y.root")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
            & (most * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n")))
            & ((F.col("x.cell") != F.col("y.cell")) | (F.abs(F.col("x.far") - F.col("y.far")) <= radius + 1e-9))
            & (_apart("x.counts", "y.counts") * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))))
        pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & fits).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = durable(pairs.join(done, ["a", "b"], "left_anti"))
        found = durable(_measured(pairs, classes, rows, length, percent))
        compared = compared.union(pairs)
        fresh = found.where("linked").select("a", "b")
        if not fresh.isEmpty():
            # nodes hang at their roots already, so only the fresh links have to be followed
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(fresh))
        first, step = first + step, step * 8
    # the least id of a component, by classes first
    table = sketch.where("n > 0").groupBy("cls").agg(F.min("id").alias("least")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    table = durable(table)
    named = table.join(table.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "root", "component_id")
    out = sketch.join(named.withColumnRenamed("cls", "of"), (F.col("cls") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "root", "row")
