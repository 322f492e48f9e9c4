"""A stream of queries against a fixed gallery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import knn


def search_stream(queries: DataFrame, gallery: DataFrame, path: str, checkpoint: str, k: int = 10, metric: str = "cosine") -> StreamingQuery:
    """Append the ``k`` nearest gallery rows of each arriving query to ``path``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so results appear once.
    """

    def batch(df: DataFrame, number: int) -> None:
        knn(df, gallery, k, metric).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
