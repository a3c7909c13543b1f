"""Ordered per-key and global scans that stay parallel when one key holds a large share of the rows.

``lag``, running sum and running maximum are computed per piece of bounded size. One summary row per piece is then
scanned in order and its result is carried into the pieces, so that no task has to read a whole hot key.
"""

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from biflux.runtime import durable

HEAVY_SHARE = 1 / 16384
HEAVY_ROWS = 2_000_000
_SLOTS = 65536


def heavy_keys(df: DataFrame, keys: list[str], min_rows: int = HEAVY_ROWS, share: float = HEAVY_SHARE) -> list[Row]:
    """Keys with more than ``max(min_rows, share * total)`` rows; there can be at most ``1 / share`` of them.

    The first job counts hash slots (at most 65536 result rows, map-side combined). Exact keys are counted only inside
    slots that are themselves heavy, so the usual table without a hot key costs one pass and almost no shuffle.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(_SLOTS))
    slots = df.groupBy(slot.alias("slot")).count().collect()
    limit = max(min_rows, share * sum(r["count"] for r in slots))
    full = [r["slot"] for r in slots if r["count"] > limit]
    if not full:
        return []
    return df.where(slot.isin(full)).groupBy(*keys).count().where(F.col("count") > limit).drop("count").collect()


def split_heavy(df: DataFrame, keys: list[str], heavy: list[Row]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of the (at most ``1 / share``) heavy keys."""
    schema = df.select(*keys).schema
    hot = F.broadcast(df.sparkSession.createDataFrame(heavy, schema))
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def _exclusive(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _pieced(df: DataFrame, keys: list[str], order: list, piece: list[str], lag, total, peak) -> DataFrame:
    inner = Window.partitionBy(*keys, *piece).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*piece) if keys else Window.orderBy(*piece)
    rank = F.struct(*order)
    summary = df.groupBy(*keys, *piece).agg(
        *[F.max_by(c, rank).alias(f"_{n}") for n, c in lag.items()],
        *[F.sum(c).alias(f"_{n}") for n, c in total.items()],
        *[F.max(c).alias(f"_{n}") for n, c in peak.items()],
    )
    carry = summary.select(
        *keys, *piece,
        *[F.lag(f"_{n}").over(outer).alias(f"_{n}") for n in lag],
        *[F.sum(f"_{n}").over(_exclusive(outer)).alias(f"_{n}") for n in total],
        *[F.max(f"_{n}").over(_exclusive(outer)).alias(f"_{n}") for n in peak],
    )
    local = df.select(
        "*", F.row_number().over(inner).alias("_turn"),
        *[F.lag(c).over(inner).alias(n) for n, c in lag.items()],
        *[F.sum(c).over(_exclusive(inner)).alias(n) for n, c in total.items()],
        *[F.max(c).over(_exclusive(inner)).alias(n) for n, c in peak.items()],
    )
    zero = F.lit(0)
    return local.join(carry, [*keys, *piece]).select(
        *df.columns,
        *[F.when(F.col("_turn") == 1, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in lag],
        *[(F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_{n}"), zero)).alias(n) for n in total],
        *[F.greatest(F.col(n), F.col(f"_{n}")).alias(n) for n in peak],
    )


def keyed_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    piece: dict[str, Column],
    lag: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    peak: dict[str, Column] | None = None,
    heavy: list[Row] | None = None,
) -> DataFrame:
    """Add, per row, values over the earlier rows of its key: previous value, sum and maximum.

    ``piece`` names columns that grow with ``order`` and cut a key into pieces of bounded size; they are used for heavy
    keys only. Ordinary keys use one window per key.
    """
    lag, total, peak = lag or {}, total or {}, peak or {}
    heavy = heavy_keys(df, keys) if heavy is None else heavy
    columns = df.columns
    window = Window.partitionBy(*keys).orderBy(*order)

    def plain(part: DataFrame) -> DataFrame:
        return part.select(
            *columns,
            *[F.lag(c).over(window).alias(n) for n, c in lag.items()],
            *[F.coalesce(F.sum(c).over(_exclusive(window)), F.lit(0)).alias(n) for n, c in total.items()],
            *[F.max(c).over(_exclusive(window)).alias(n) for n, c in peak.items()],
        )

    if not heavy:
        return plain(df)
    cold, hot = split_heavy(df, keys, heavy)
    hot = hot.select(*columns, *[c.alias(n) for n, c in piece.items()])
    hot = _pieced(hot, keys, order, list(piece), lag, total, peak).drop(*piece)
    return plain(cold).unionByName(hot)


def global_scan(
    df: DataFrame,
    order: list[str],
    lag: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    peak: dict[str, Column] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """The same values over the whole table in one total order (``order`` must be unique per row).

    The table is range-partitioned, so pieces are even whatever the distribution of the order columns. The piece
    number is checkpointed with the rows because both passes must see the same cut. Only one row per piece meets in
    the un-partitioned window.
    """
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = durable(df.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()))
    return _pieced(staged, [], order, ["_piece"], lag or {}, total or {}, peak or {}).drop("_piece")
