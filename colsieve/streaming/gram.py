"""A Gram matrix that follows a stream of matrix columns, for selections that only see X through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colsieve.functions.linalg import gram


def follow_gram(stream: DataFrame, path: str, checkpoint: str, vec: str = "vec") -> StreamingQuery:
    """Each micro-batch writes its own m x m partial under its batch id; a repeated batch replaces itself."""

    def add(batch: DataFrame, batch_id: int) -> None:
        gram(batch, vec).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_gram(partials: DataFrame) -> DataFrame:
    """The sum of the partials (i, j, v)."""
    return partials.groupBy("i", "j").agg(F.sum("v").alias("v"))
