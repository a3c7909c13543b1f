"""Session-level helpers: durable lineage cuts and size-checked broadcasts."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from biflux.schemas import FlowDataError


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as ``spark.checkpoint.dir`` names it.

    Only a local session (tests) without that setting gets a folder of its own: a machine-local one would not outlive
    a lost executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise FlowDataError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="biflux-")
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage like ``durable``, with the rows as compressed columns beside the checkpoints.

    For wide tables that are read several times: a reader takes only the columns it needs, and what was shuffled to make the
    rows is given up once they are written. Neither order nor partitions are kept.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    path = f"{context.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    cleanup, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        before = spark.conf.get(cleanup)
        spark.conf.set(cleanup, "true")
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that are computed once per row.

    Spark copies the expression of a plain column into every filter and lambda that reads it; it does not move one out of
    a generator. The outer form adds no filter on the generator's input, which would compute it twice.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only for a table counted to be at most ``max_rows`` rows; beyond it Spark shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """Keep Spark from sending a table to the driver for a broadcast: it takes a table after an explode for as small as before, also
    behind a checkpoint."""
    return df.hint("merge")


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of parameters (never of data) given by the caller."""
    return spark.createDataFrame(rows, schema)
