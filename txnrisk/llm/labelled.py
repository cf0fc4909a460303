"""Statistics of labelled documents, the input of both quality models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.llm.docstats import FEATURES, statistics
from txnrisk.llm.texts import map_texts, raw_text
from txnrisk.sources.workspace import settled

HELD_OUT = 2


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit may read: crc32 of the id as text, modulo 4, is 2."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == HELD_OUT


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of rows that are not held out. Labels other than 0 and 1 and null ids are passed
    over; an id labelled twice counts once, as 0 if its labels differ."""
    known = F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)
    return (
        labels.filter(known & ~is_held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"))
    )


def bounded_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of either label, always the same ones: those of least hashed ids."""
    order = F.xxhash64("id"), F.col("id")
    each = [labels.filter(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return each[0].union(each[1])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one column per feature) of all documents, as a written table.

    A hundred bytes a document: what is joined, fitted and scored afterwards never holds texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(columns: list[list]) -> list[list]:
        ids, texts = columns
        return [ids, *map(list, zip(*(statistics(t)[1] for t in texts)))]

    schema = f"id {kind}, " + ", ".join(f"{f} double" for f in FEATURES)
    return settled(map_texts(docs, [F.col(id_col).alias("id"), raw_text(text_col)], schema, rows))


def sampled_statistics(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(label, one column per feature) of a bounded sample (id, label), which is broadcast.

    One row per id: of rows that repeat one, that of the least hashed text.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(sample), "id")
    kind = chosen.schema["id"].dataType.simpleString()

    def rows(columns: list[list]) -> list[list]:
        *told, some = columns
        return [*told, *map(list, zip(*(statistics(t)[1] for t in some)))]

    schema = f"id {kind}, label int, text_hash long, " + ", ".join(f"{f} double" for f in FEATURES)
    source = [F.col("id"), F.col("label"), F.xxhash64("text"), raw_text("text")]
    found = map_texts(chosen, source, schema, rows)
    least = found.groupBy("id").agg(F.min(F.struct("text_hash", "label", *FEATURES)).alias("row"))
    return settled(least.select("row.label", *(f"row.{f}" for f in FEATURES)))
