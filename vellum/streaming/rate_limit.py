"""Fixed-window rate limits: one transformation for batch and stream.

Windows tumble on event time.  In a batch every request gets its decision by
its rank in the window; a stream keeps counts by (window, client) under a
watermark and tells by how much each went over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decided(requests: DataFrame, width: str, limit: int) -> DataFrame:
    """``requests(req_id, ts, client)`` with ``allowed``: among the first ``limit`` of its window."""
    w = Window.partitionBy("client", F.window("ts", width)).orderBy("ts", "req_id")
    return requests.withColumn("allowed", F.row_number().over(w) <= limit)


def counted(requests: DataFrame, width: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """(start, client, n, rejected) of each window; works on streams, late data up to ``late``."""
    requests = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    g = rows.groupBy(F.window("ts", width).alias("w"), "client").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "client", "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))
