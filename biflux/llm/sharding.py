"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source blocks. How many rows of a block go to a shard is drawn exactly as a uniform permutation of all rows
would deal them (multivariate hypergeometric, row by row of the matrix). Then every block permutes its rows and cuts
them by its row of the matrix, and every shard permutes what it got.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from biflux.llm.common import literal_table, utf8
from biflux.runtime import durable


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items out of ``good + bad`` are good, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    up = down = mode
    p_up = p_down = at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(block_rows: list[int], capacities: list[int], seed: int) -> list[list[int]]:
    """Rows of each block that go to each shard; row sums are the blocks' rows, column sums the capacities."""
    rng, free, matrix = random.Random(seed), list(capacities), []
    for rows in block_rows:
        dealt, left, rest = [], rows, sum(free)
        for s, room in enumerate(free):
            rest -= room
            count = hypergeometric(rng, room, rest, left)
            dealt.append(count)
            left -= count
        free = [room - count for room, count in zip(free, dealt)]
        matrix.append(dealt)
    return matrix


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 20,
          rows_per_block: int = 20_000, max_blocks: int = 4096) -> DataFrame:
    """Put every row into one of ``shards`` shards; counts differ by one at most.

    Returns (id, size, text_crc32, shard, slot). Rows are dealt by hashes of id and text, so a retry repeats the result.
    A null text is empty, a null id a value like any other; identical rows are interchangeable; an empty table gives no
    rows; other columns are ignored. The matrix has at most ``max_blocks`` x ``shards`` numbers, whatever the table has.
    """
    text = utf8(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"))

    def draw(purpose: int):
        return F.xxhash64(F.lit(seed), F.lit(purpose), "id", "crc", "size")

    spark = docs.sparkSession
    rows = durable(rows.withColumns({"h0": draw(0), "h1": draw(1), "h2": draw(2)}))
    total = rows.count()
    blocks = max(256, min(max_blocks, total // rows_per_block))
    rows = rows.withColumn("block", F.pmod("h0", F.lit(blocks)).cast("int"))
    counted = {r.block: r.n for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    sizes = [counted.get(b, 0) for b in range(blocks)]
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    cuts = []
    for b, dealt in enumerate(communication_matrix(sizes, capacities, seed)):
        ends = [0]
        for count in dealt:
            ends.append(ends[-1] + count)
        cuts.append({"block": b, "ends": ends[1:]})
    cuts = literal_table(spark, json.dumps(cuts), "block int, ends array<bigint>")

    # the local permutation: a block's rows in random order, cut by its row of the matrix
    in_block = F.row_number().over(Window.partitionBy("block").orderBy("h1", "id", "crc", "size"))
    dealt = (
        rows.withColumn("place", in_block.cast("long")).join(F.broadcast(cuts), "block")
        .withColumn("shard", F.size(F.filter("ends", lambda end: end < F.col("place"))).cast("int")))
    # the exchange and the second permutation: order by h2 within a shard, ranked in pieces of the range of h2
    bits = max(1, (max(1, total // (shards * rows_per_block))).bit_length())
    dealt = durable(dealt.select("id", "size", "crc", "shard", "h2", F.shiftrightunsigned("h2", 64 - bits).alias("piece")))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
        .select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    in_piece = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("h2", "id", "crc", "size"))
    return dealt.join(offsets, ["shard", "piece"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + in_piece - 1).cast("long").alias("slot"))
