"""Documents beside their successors in id order, in one shuffle and without a global window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from txnrisk.llm.texts import pieces_of

LEAST = -(2**63)  # order of a null id
SLICES_PER_TASK = 4  # slices are dealt by hash; several small ones fill tasks more evenly than one


def map_with_next(
    docs: DataFrame,
    prepare: Callable[[str], object],
    compare: Callable[[object, object], tuple],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row (id, *compare(own, next)) per document; both sides are what ``prepare`` made of the texts.

    The next document is the one with the next higher id (integers; nulls come first; repeated ids stand
    in the order of their texts), and the first one for the last. Ids are cut into as many slices as
    there are shuffle partitions, times four, by quantiles; a task sorts a slice and holds one document at a time. The first
    document of every slice also goes to the slice before. Only one number per slice reaches the
    driver. A null text is an empty one.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    keys = docs.select(key.alias("key"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = SLICES_PER_TASK * tasks
    shares = [i / wanted for i in range(1, wanted)]
    cuts = np.unique(keys.approxQuantile("key", shares, 1 / (4 * wanted)) if shares else [])

    @F.pandas_udf("int")
    def slice_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, values.to_numpy(float), side="right"), dtype="int32")

    firsts = keys.groupBy(slice_of("key").alias("slice")).agg(F.min("key").alias("first")).collect()
    filled = sorted((r["slice"], r["first"]) for r in firsts)
    before = {first: filled[i - 1][0] for i, (_, first) in enumerate(filled)}

    @F.pandas_udf("slice int, also int")
    def places(values: pd.Series) -> pd.DataFrame:
        own = np.searchsorted(cuts, values.to_numpy(float), side="right")
        return pd.DataFrame(
            {"slice": own.astype("int32"), "also": values.map(before).astype("Int32")}
        )

    rows = docs.select(
        F.col(id_col).alias("id"),
        key.alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        places(key).alias("place"),
    )
    own = F.struct(F.col("place.slice").alias("slice"), F.lit(False).alias("extra"))
    also = F.struct(F.col("place.also").alias("slice"), F.lit(True).alias("extra"))
    both = F.when(F.col("place.also").isNull(), F.array(own)).otherwise(F.array(own, also))
    dealt = (
        rows.select("id", "key", "text", F.explode(both).alias("to"))
        .select("to.slice", "to.extra", "id", "key", "text")
        .repartition(max(1, min(tasks, len(filled))), "slice")
        .sortWithinPartitions("slice", "extra", "key", "text")
        .select("slice", "extra", "id", "text")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    types = StructType.fromDDL(f"id {kind}, {schema}")
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (slice, id, prepared) of the document that waits for its successor
        for piece in pieces_of(batches):
            made = []
            for in_slice, extra, name, text in zip(*(c.to_pylist() for c in piece.columns)):
                if held is not None and held[0] != in_slice:
                    held = None
                if extra and held is None:
                    continue
                now = (in_slice, name, prepare(text))
                if held is not None:
                    made.append((held[1], *compare(held[2], now[2])))
                held = None if extra else now
            columns = zip(*made) if made else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return dealt.mapInArrow(run, types)
