"""Daily landing as a file stream: the stream's own log knows which files were taken, and each
batch commits its days into the landing folder's manifest, the log that batch landing reads too."""

from __future__ import annotations

from pyspark.sql import SparkSession

from txnrisk import schema as S
from txnrisk.sources.landing import land_batch


def land_stream(spark: SparkSession, inbox: str, folder: str, progress: str) -> None:
    """Take every file not seen before, add it to its days, and stop.

    Each batch is landed by ``land_batch`` under the tag ``stream-<batch id>``: a run that is cut
    short and started again replays its last batch, which neither loses nor repeats a row.
    """
    arrivals = spark.readStream.schema(S.RAW).option("recursiveFileLookup", True).parquet(inbox)
    query = (
        arrivals.writeStream.foreachBatch(lambda batch, batch_id: land_batch(batch, folder, f"stream-{batch_id}"))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
