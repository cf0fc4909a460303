"""Quality rules: fixed limits, then boosted trees over document statistics.

The trees are trained on a bounded sample of labelled documents and flattened into node arrays that score a
batch at a time. More symbols, capitals, repeated lines, windows or words never raise a document's score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.llm.boosted_trees import Trees, fit as fit_trees
from txnrisk.llm.docstats import COUNTS, FEATURES, statistics
from txnrisk.llm.labelled import bounded_sample, sampled_statistics, training_labels
from txnrisk.llm.texts import map_texts, raw_text

LEAST_WORDS = 10
REPEAT_PERCENT = 20
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "echo_share")
VERDICT = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 10_000,
) -> Trees:
    """Trains on at most ``per_class`` documents of either label (see ``bounded_sample``), the only rows
    that reach the driver, as numbers. Sampled rows are weighted back to the shares of the classes among
    all training labels. Without labels of both classes every document scores the smoothed share."""
    known = training_labels(labels, id_col, label_col)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    wanted = bounded_sample(known, per_class)
    rows = sampled_statistics(docs, wanted, id_col, text_col).toPandas().sort_values(["label", *FEATURES])
    x = rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES))
    stands_for = {k: n / min(n, per_class) for k, n in counts.items()}  # labels for each one sampled
    weight = rows["label"].map(stands_for).to_numpy(float)
    weight *= len(weight) / max(weight.sum(), 1)
    monotone = [-1 if f in FALLING else 0 for f in FEATURES]
    return fit_trees(x, rows["label"].to_numpy(float), monotone, weight=weight)


def judged(texts, model: Trees, keep_at: float) -> list[list]:
    """The VERDICT columns of a batch of texts."""
    counts, features = zip(*map(statistics, texts)) if len(texts) else ((), ())
    counts = np.array(counts, np.int64).reshape(-1, len(COUNTS))
    score = model.score(np.array(features).reshape(-1, len(FEATURES)))
    n_words, repeat = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
    failed = (n_words < LEAST_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
    return [*counts.T.tolist(), failed.tolist(), score.tolist(), (~failed & (score >= keep_at)).tolist()]


def judge_documents(
    docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5
) -> DataFrame:
    """(id, counts, base_failed, score, kept) for every row.

    A null or empty text has no words and fails the base. Repeated rows stay; other columns are not read; an
    empty table gives no rows. Very long texts are read whole. A score exactly at ``keep_at`` keeps the
    document (ties keep).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(columns: list[list]) -> list[list]:
        ids, texts = columns
        return [ids, *judged(texts, model, keep_at)]

    return map_texts(docs, [F.col(id_col).alias("id"), raw_text(text_col)], f"id {kind}, {VERDICT}", rows)


def kept_by(text_col: str, model: Trees, keep_at: float = 0.5) -> Column:
    """The verdict ``kept`` as a column, for filters that keep whole rows."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(judged(texts, model, keep_at)[-1], dtype=bool)

    return kept(raw_text(text_col))
