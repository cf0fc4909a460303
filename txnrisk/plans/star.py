"""Star schema: build, publish, open, and the enriched view."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, types as T

from txnrisk import schema as S
from txnrisk.operators import dims, quality
from txnrisk.operators.features import (
    DAY_ORDER,
    fact_cut_rows,
    labelled,
    running_features,
    time_features,
)
from txnrisk.operators.running import in_ranges
from txnrisk.sources import files
from txnrisk.sources.workspace import fresh_path, together

VIEW = "vw_txn_enriched"
CLEAN = T.StructType([S.FACT[c] for c in quality.CLEAN_COLUMNS])


@dataclass(frozen=True)
class Star:
    fact: DataFrame
    date: DataFrame
    customer: DataFrame
    terminal: DataFrame
    band: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(
            zip(S.TABLES, (self.fact, self.date, self.customer, self.terminal, self.band))
        )


def stage_clean(raw: DataFrame, folder: str, quarantine: str | None = None) -> DataFrame:
    """Cleaned rows as a written table: the feature windows read them more than once.

    A value that does not convert stops the job, or with ``quarantine`` sends its row, as it came,
    to that folder.
    """
    if quarantine:
        rows, rejected = quality.typed_with_quarantine(quality.rename_and_prune(raw))
        files.write_parquet(rejected, quarantine)
        files.write_parquet(quality.clean_typed(rows), folder)
    else:
        files.write_parquet(quality.clean(raw), folder)
    return raw.sparkSession.read.schema(CLEAN).parquet(folder)


def build_from_clean(
    rows: DataFrame, folder: str, daily_folders: bool = True, terminal_order: str = "customer"
) -> Star:
    """Add features, write the fact once, and derive every dimension from what was written."""
    spark = rows.sparkSession
    target = f"{folder}/fact_transactions"
    dated = time_features(rows)
    drawn = fact_cut_rows(rows, terminal_order)
    featured = time_features(running_features(rows, terminal_order, drawn))
    dealt = in_ranges(featured, "date_key", DAY_ORDER, dated, drawn)
    files.write_fact(labelled(dealt), target, daily_folders=daily_folders, dealt=True)
    write_dimensions(files.read_fact(spark, target), folder)
    return open_star(spark, folder)


def write_dimensions(fact: DataFrame, folder: str) -> None:
    """Every dimension from the written fact; they don't depend on each other."""

    def write(name: str, build) -> None:
        files.write_parquet(build(fact), f"{folder}/{name}")

    together(
        fact.sparkSession,
        partial(write, "dim_customer", dims.build_dim_customer),
        partial(write, "dim_terminal", dims.build_dim_terminal),
        partial(write, "dim_date", dims.build_dim_date),
        partial(write, "dim_amount_band", dims.build_dim_amount_band),
    )


def build_star(
    raw: DataFrame, folder: str, daily_folders: bool = True, quarantine: str | None = None
) -> Star:
    """Raw transactions to a written star schema."""
    rows = stage_clean(raw, f"{folder}/clean", quarantine)
    return build_from_clean(rows, folder, daily_folders)


def open_star(spark: SparkSession, folder: str) -> Star:
    parents = [n for n in S.TABLES if n != "fact_transactions"]
    return Star(
        files.read_fact(spark, f"{folder}/fact_transactions"),
        *[files.read_parquet(spark, f"{folder}/{n}", S.TABLES[n]) for n in parents],
    )


def publish(star: Star, database: str = "default", customer_buckets: int = 0) -> None:
    """Save the star as catalog tables with column statistics for the optimizer, and the enriched
    view (``vw_txn_enriched``) as a view of the catalog over them.

    ``customer_buckets`` lays fact and customers out by customer instead of by day, so that joins
    and groupings on the customer need no shuffle when both tables are too large to broadcast. A
    bucket holds whole customers, so it is unfit where one customer has a large share of the rows.
    """
    spark = star.fact.sparkSession

    def save(name: str, df: DataFrame) -> None:
        target = f"{database}.{name}"
        writer = df.write.mode("overwrite").format("parquet")
        if customer_buckets and "customer_id" in df.columns:
            # one file per bucket: rows arrive already hashed the way the buckets are
            df = df.repartition(customer_buckets, "customer_id")
            writer = df.write.mode("overwrite").format("parquet")
            writer = writer.bucketBy(customer_buckets, "customer_id").sortBy("customer_id")
        elif name == "fact_transactions":
            writer = writer.partitionBy("date_key")
        writer.saveAsTable(target)
        spark.sql(f"ANALYZE TABLE {target} COMPUTE STATISTICS FOR ALL COLUMNS")

    # the dimensions' small steps run beside the fact's
    together(spark, *[partial(save, name, df) for name, df in star.tables().items()])
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{VIEW} AS {enriched_sql(database)}")


def enriched_sql(database: str) -> str:
    """The enriched view as SQL over the published tables, for the catalog (every session sees it)."""
    return f"""SELECT f.transaction_id, f.txn_datetime, d.date, d.month_name, d.day_name, d.is_weekend,
       f.customer_id, c.value_segment, f.terminal_id, t.risk_tier AS terminal_risk_tier, f.amount,
       f.amount_band, f.txn_hour, f.part_of_day, f.amount_vs_cust_avg, f.mins_since_prev_txn, f.is_fraud,
       f.fraud_type
FROM {database}.fact_transactions f
JOIN {database}.dim_date d ON d.date_key = f.date_key
JOIN {database}.dim_customer c ON c.customer_id = f.customer_id
JOIN {database}.dim_terminal t ON t.terminal_id = f.terminal_id"""


def open_published(spark: SparkSession, database: str = "default") -> Star:
    """The star from its catalog tables."""
    return Star(
        *[spark.table(f"{database}.{n}").select(S.TABLES[n].fieldNames()) for n in S.TABLES]
    )


def enriched(star: Star, rows: DataFrame | None = None) -> DataFrame:
    """Eighteen columns over fact (or some of its rows) and three dimensions.

    No broadcast hints: the dimensions are written tables, so Catalyst knows their size and
    broadcasts what is under the session's threshold; a larger one becomes a sort-merge join whose
    heavy keys adaptive execution splits.
    """
    days = star.date.select("date_key", "date", "month_name", "day_name", "is_weekend")
    customers = star.customer.select("customer_id", "value_segment")
    terminals = star.terminal.select(
        "terminal_id", star.terminal["risk_tier"].alias("terminal_risk_tier")
    )
    return (
        (star.fact if rows is None else rows)
        .join(days, "date_key")
        .join(customers, "customer_id")
        .join(terminals, "terminal_id")
        .select(
            "transaction_id",
            "txn_datetime",
            "date",
            "month_name",
            "day_name",
            "is_weekend",
            "customer_id",
            "value_segment",
            "terminal_id",
            "terminal_risk_tier",
            "amount",
            "amount_band",
            "txn_hour",
            "part_of_day",
            "amount_vs_cust_avg",
            "mins_since_prev_txn",
            "is_fraud",
            "fraud_type",
        )
    )


def register_view(star: Star) -> DataFrame:
    view = enriched(star)
    view.createOrReplaceTempView(VIEW)
    return view


_staged: dict[tuple, DataFrame] = {}
_opened: dict[tuple, Star] = {}


def _state_of(spark: SparkSession, source: str) -> tuple:
    """Size, number of files and last change of a source folder: another state, another star."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    told = store.getContentSummary(path)
    changed = max((s.getModificationTime() for s in store.listStatus(path)), default=0)
    return told.getLength(), told.getFileCount(), changed


def clean_for(raw_reader, spark: SparkSession, source: str) -> DataFrame:
    """Cleaned rows of a source, staged once per application and state of the source."""
    app = spark.sparkContext.applicationId
    key = (app, raw_reader.__name__, source, _state_of(spark, source))
    if key not in _staged:
        _staged[key] = stage_clean(raw_reader(spark, source), fresh_path(spark, "clean"))
    return _staged[key]


def star_for(raw_reader, spark: SparkSession, source: str, daily_folders: bool = True) -> Star:
    """The star of a source, built once per application and state of the source.

    It is read from the shared folder. The written tables never change, so the opened frames (and
    their file listings) are kept.
    """
    app = spark.sparkContext.applicationId
    key = (app, raw_reader.__name__, source, _state_of(spark, source), daily_folders)
    if key not in _opened:
        rows = clean_for(raw_reader, spark, source)
        folder = fresh_path(spark, "star")
        _opened[key] = build_from_clean(rows, folder, daily_folders=daily_folders)
    return _opened[key]
