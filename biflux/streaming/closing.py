"""The two ends of a stream: what its state holds after the last batch, and the rows that came too late."""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0, variable: str | None = None) -> DataFrame:
    """Keys and values that a stopped query's operator still keeps, read from its state store in parallel."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)


def drain(query: StreamingQuery, pause: float = 0.2) -> dict[int, dict[str, int]]:
    """Wait for a query that ends by itself; per batch the rows read and the rows that its state operators dropped as late.

    Progress is picked up while the query runs, since a session keeps only the last hundred reports of it.
    """
    seen: dict[int, dict[str, int]] = {}

    def note() -> None:
        for p in query.recentProgress:
            late = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
            if p["numInputRows"] or late or p["batchId"] not in seen:
                seen[p["batchId"]] = {"rows": p["numInputRows"], "late": late}

    while query.isActive:
        note()
        time.sleep(pause)
    query.awaitTermination()
    note()
    return seen
