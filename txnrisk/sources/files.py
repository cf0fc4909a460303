"""File sources and sinks. Reads declare their schema, or take each file's own and bind it by name."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txnrisk import schema as S
from txnrisk.operators.quality import SOURCE_FILE


def read_daily_files(spark: SparkSession, folder: str, file_format: str = "parquet") -> DataFrame:
    """The raw columns of all daily files, with the file each row came from, which orders duplicates.

    Files are grouped by their own layout (a Parquet file's footer schema, a CSV file's header line);
    each group is read with that layout and bound by name, and the groups are united. A column whose
    type differs between groups (number ids on some days, text ids on others) is read as text in all
    of them; CSV stays text. The conversion, which stops at or sets aside values that do not fit, is
    ``quality.typed`` or ``quality.typed_with_quarantine``. Only file names and first lines or
    footers are read on the driver.
    """
    names = S.RAW.fieldNames()
    groups: dict[str, list[str]] = {}
    for path in data_files(spark, folder):
        if file_format == "csv":
            layout = _first_line(spark, path)
        else:
            layout = spark.read.format(file_format).load(path).schema.json()
        groups.setdefault(layout, []).append(path)
    if not groups:
        raise FileNotFoundError(f"no data files in {folder}")
    parts = []
    for layout, paths in groups.items():
        if file_format == "csv":
            text = T.StructType([T.StructField(n.strip(), T.StringType()) for n in layout.split(",")])
            parts.append(spark.read.schema(text).options(header=True, enforceSchema=False).csv(paths))
        else:
            own = T.StructType.fromJson(json.loads(layout))
            parts.append(spark.read.schema(own).format(file_format).load(paths))
    types = {n: {p.schema[n].dataType for p in parts} for n in names}
    bound = [
        p.select(
            *[F.col(n) if len(types[n]) == 1 else F.col(n).cast("string").alias(n) for n in names],
            F.col("_metadata.file_path").alias(SOURCE_FILE),
        )
        for p in parts
    ]
    rows = bound[0]
    for more in bound[1:]:
        rows = rows.unionByName(more)
    return rows


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the data files under a folder, passing over names that start with ``_`` or ``.``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = str(store.makeQualified(root).toUri().getPath()).rstrip("/")
    found = []
    listing = store.listFiles(root, True)
    while listing.hasNext():
        path = listing.next().getPath()
        inside = str(path.toUri().getPath())[len(base) :]
        if not any(part.startswith(("_", ".")) for part in inside.split("/") if part):
            found.append(str(path))
    return sorted(found)


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, read through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(store.open(hadoop_path), "UTF-8"))
    try:
        return (reader.readLine() or "").strip().lstrip("\ufeff")
    finally:
        reader.close()


def _header(spark: SparkSession, folder: str) -> list[str]:
    """Column names of the first CSV file, in its order."""
    return spark.read.options(header=True, recursiveFileLookup=True).csv(folder).columns


def write_daily_files(raw: DataFrame, folder: str) -> None:
    """One sub-folder per day, skipping none; the counterpart of ``read_daily_files``."""
    dated = raw.withColumn("day", F.col("TX_DATETIME").cast("date"))
    dated.repartitionByRange("day", "TX_DATETIME", "TRANSACTION_ID").write.partitionBy("day").mode(
        "append"
    ).parquet(folder)


def write_fact(
    fact: DataFrame,
    folder: str,
    mode: str = "overwrite",
    daily_folders: bool = True,
    dealt: bool = False,
) -> None:
    """Parquet partitioned by day.

    Range partitioning by (day, time, id) gives each task a stretch of one or two days, splits a
    day that holds a large share of the rows, and leaves row groups sorted by time. With mode
    ``overwrite`` only the days present in ``fact`` are replaced. Without ``daily_folders`` (many
    thin days) the same order is kept in plain files, whose row groups still prune by day.
    ``dealt`` says that ``fact`` comes in such ranges already (``running.in_ranges``).
    """
    ordered = fact if dealt else fact.repartitionByRange("date_key", "txn_datetime", "transaction_id")
    writer = ordered.sortWithinPartitions("date_key", "txn_datetime", "transaction_id").write.options(**LOOKUP_BLOOMS)
    if daily_folders:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("date_key")
    writer.mode(mode).parquet(folder)


# Parquet bloom filters: a lookup of some customers or terminals skips row groups that hold none
LOOKUP_BLOOMS = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("customer_id", "terminal_id")}


def write_terminal_copy(fact: DataFrame, folder: str, row_group_bytes: int | None = None) -> None:
    """The fact again, ordered by (terminal, time, id): row groups then hold few terminals each, so
    a lookup of some terminals reads few row groups by their min and max alone, and the bloom
    filters answer for the rest. Range partitioning splits a terminal with a large share of rows."""
    ordered = fact.repartitionByRange("terminal_id", "txn_datetime", "transaction_id")
    writer = ordered.sortWithinPartitions("terminal_id", "txn_datetime", "transaction_id").write.options(**LOOKUP_BLOOMS)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.mode("overwrite").parquet(folder)


def read_fact(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(S.FACT).parquet(folder).select(S.FACT.fieldNames())


def write_parquet(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)


def read_parquet(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


CSV_OPTIONS = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_csv(df: DataFrame, folder: str) -> None:
    """Header row and full microseconds (the CSV default keeps milliseconds)."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Typed CSV scan, columns bound by header; a value that does not fit its type fails the job."""
    found = _header(spark, folder) or schema.fieldNames()
    own = T.StructType([schema[n] for n in found])
    options = {"mode": "FAILFAST", "enforceSchema": False, **CSV_OPTIONS}
    return spark.read.schema(own).options(**options).csv(folder).select(schema.fieldNames())


def write_json(result: DataFrame, folder: str) -> None:
    """Nested results, one JSON object per row."""
    result.write.mode("overwrite").json(folder)


def read_json(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def read_slice(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A report slice; a text ``txn_date`` becomes a date."""
    rows = read_csv(spark, folder, schema)
    if "txn_date" in rows.columns:
        rows = rows.withColumn("txn_date", F.to_date("txn_date"))
    return rows
