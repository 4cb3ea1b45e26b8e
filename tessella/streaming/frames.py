"""Per-image operators over a stream: they hold no state, so any of them runs batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def apply_to_stream(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Starts a query that appends `operator`'s rows of each micro-batch to a Parquet folder."""

    def batch(df: DataFrame, number: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
