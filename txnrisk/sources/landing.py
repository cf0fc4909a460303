"""Idempotent daily landing: days that are already there are left alone.

Rows without a time land in a day of their own (``UNDATED``). A day counts as landed once its number
is in the folder's manifest, which is written after the rows; a day that a broken run left half
written is therefore replaced by the next run.

The manifest is the one commit log of the folder, for batch and stream landing alike: each write
has a tag (``batch-<id>`` or ``stream-<batch id>``), stamped on its rows (``landed_by``) and on its
manifest rows. A stream batch adds its rows to days that are already landed, leaving out rows with
its own tag and rows whose transaction id the day already holds from another write, so a batch that
is run again after a failure between rows and manifest, or a file that a batch run landed before,
neither loses nor repeats a row; a batch whose tag is in the manifest is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txnrisk import schema as S
from txnrisk.functions.dates import date_key, day
from txnrisk.sources.workspace import settled


UNDATED = 0
MANIFEST = "_landed"  # scans of the folder pass over names with an underscore
DAY = "date_key int"
LOG = "date_key int, tag string"
TAG = "landed_by"


def landing_day() -> Column:
    return F.coalesce(date_key(day(F.col("TX_DATETIME"))), F.lit(UNDATED))


def landed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days that a landing folder holds completely."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return spark.createDataFrame([], DAY)
    return spark.read.schema(DAY).parquet(f"{folder}/{MANIFEST}").distinct()


def commit_log(spark: SparkSession, folder: str) -> DataFrame:
    """(date_key, tag) of every committed write; tags are null for writes older than tags."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{folder}/{MANIFEST}")


def read_landed(spark: SparkSession, folder: str, tagged: bool = False) -> DataFrame:
    fields = S.RAW.fields + [S.FACT["date_key"]] + ([S.T.StructField(TAG, S.T.StringType())] if tagged else [])
    return spark.read.schema(S.T.StructType(fields)).parquet(folder)


def land_new_days(raw: DataFrame, folder: str) -> None:
    """Add the days of ``raw`` that the folder lacks. A second run adds nothing."""
    dated = raw.withColumn("date_key", landing_day())
    present = landed_days(raw.sparkSession, folder)
    _write(dated.join(F.broadcast(present), "date_key", "left_anti"), folder)  # one row per calendar day


def replace_days(raw: DataFrame, folder: str) -> None:
    """Rewrite exactly the days found in ``raw``; running it again gives the same folder."""
    _write(raw.withColumn("date_key", landing_day()), folder)


def land_batch(raw: DataFrame, folder: str, tag: str) -> None:
    """Add the rows of one stream batch: new days are written, landed days get the rows added.

    Replaying the same tag after a failure before its manifest rows gives the same folder; after
    them, nothing happens.
    """
    spark = raw.sparkSession
    log = commit_log(spark, folder)
    if not log.filter(F.col("tag") == tag).isEmpty():
        return
    dated = raw.withColumn("date_key", landing_day())
    present = log.select("date_key").distinct()
    old = read_landed(spark, folder, tagged=True) if not present.isEmpty() else None
    if old is not None:
        theirs = old.join(F.broadcast(present), "date_key", "left_semi").join(
            dated.select("date_key").distinct(), "date_key", "left_semi"
        )
        theirs = settled(theirs.filter(F.col(TAG).isNull() | (F.col(TAG) != tag)).select(*dated.columns, TAG))
        fresh = dated.join(theirs.select("date_key", "TRANSACTION_ID"), ["date_key", "TRANSACTION_ID"], "left_anti")
        dated = settled(fresh.select(*dated.columns).withColumn(TAG, F.lit(tag)).unionByName(theirs))
    _write(dated, folder, tag)


def _write(dated: DataFrame, folder: str, tag: str | None = None) -> None:
    """Write the rows, then the days, one row each, with the write's tag into the manifest."""
    tag = tag or f"batch-{uuid.uuid4().hex[:12]}"
    if TAG not in dated.columns:
        dated = dated.withColumn(TAG, F.lit(tag))
    days = dated.select("date_key").distinct().coalesce(1).withColumn("tag", F.lit(tag))
    days = settled(days)  # before the rows arrive, since the rows' own manifest decides which days are new
    (
        dated.repartitionByRange("date_key", "TX_DATETIME", "TRANSACTION_ID")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date_key")
        .parquet(folder)
    )
    days.write.mode("append").parquet(f"{folder}/{MANIFEST}")
