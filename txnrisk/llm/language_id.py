"""Language identification by hyperdimensional profiles.

Every letter (a code point that ``str.isalpha`` accepts, lower-cased) owns a random bipolar
vector of ``DIMS`` signs, drawn from the code point alone, so every executor draws the same. A
letter trigram binds the vectors of its letters after rotating the first by two and the second by
one place, elementwise; a text's profile bundles (sums) the vectors of all its trigrams, repeats
included. Runs of other characters count as one space, so trigrams span word edges. A language's
prototype bundles the unit profiles of its training texts; a text takes the language of the
prototype nearest by cosine.

Training pre-aggregates inside each task (one partial bundle per language and task), so a language
that holds a third of all texts costs the same as any other; only the bundles, one vector per
language, reach the driver, at most ``MAX_LANGS`` of them.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Ties between
languages go to the least language name. Repeated rows are scored alike and train as often as they
occur. Very long texts cost time in proportion to their length and memory in proportion to their
distinct trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.texts import free_name, map_texts, pieces_of

DIMS = 1024  # signs per vector
SEED = 42
MAX_LANGS = 4096  # most prototypes that may travel to the driver and back to every task
UNKNOWN = "und"
GAP = " "


@lru_cache(maxsize=8192)
def letter_vector(point: int) -> np.ndarray:
    """The bipolar vector of one code point (the gap included), the same on every machine."""
    rng = np.random.default_rng([SEED, point])
    return (rng.integers(0, 2, DIMS, dtype=np.int8) * 2 - 1).astype(np.int8)


@lru_cache(maxsize=8192)
def letter_rows(point: int) -> np.ndarray:
    """The vector of a code point rotated by 0, 1 and 2 places, as float32 rows."""
    base = letter_vector(point).astype(np.float32)
    return np.stack([base, np.roll(base, 1), np.roll(base, 2)])


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters, by ``str.isalpha``."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def symbols(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else one gap, a gap at either end."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    points = np.where(letters()[points], points, ord(GAP))
    points = np.concatenate(([ord(GAP)], points, [ord(GAP)]))
    keep = np.ones(points.size, dtype=bool)
    keep[1:] = (points[1:] != ord(GAP)) | (points[:-1] != ord(GAP))
    return points[keep]


def profile(text: str | None) -> np.ndarray | None:
    """The bundle of all letter trigrams of a text (float32), or None without a letter.

    Trigrams are grouped by their first two letters: for each such pair the counts of the third
    letters times the letter vectors (one matrix product) are bound to the rotated pair once.
    """
    seq = symbols(text)
    if seq.size < 3:
        return None
    alphabet, codes = np.unique(seq, return_inverse=True)
    rows = np.stack([letter_rows(int(p)) for p in alphabet])
    size = alphabet.size
    pairs, pair_of = np.unique(codes[:-2] * size + codes[1:-1], return_inverse=True)
    counts = np.bincount(pair_of * size + codes[2:], minlength=pairs.size * size).astype(np.float32)
    thirds = counts.reshape(pairs.size, size) @ rows[:, 0]
    first, second = np.divmod(pairs, size)
    bound = rows[first, 2] * rows[second, 1]
    return np.einsum("ij,ij->j", bound, thirds)


def unit(vector: np.ndarray) -> np.ndarray:
    norm = float(np.linalg.norm(vector))
    return vector / norm if norm > 0 else vector


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train: str | None = None) -> dict[str, np.ndarray]:
    """Prototypes (unit vectors) by language, from rows whose boolean column ``train`` is true (all
    rows when None) and whose language is not null. Texts without a letter add nothing."""
    use = F.col(lang_col).isNotNull() & (F.col(train) if train else F.lit(True))
    rows = docs.filter(use).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = "lang string, n long, bundle binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for piece in pieces_of(batches):
            for lang, text in zip(*(c.to_pylist() for c in piece.columns)):
                made = profile(text)
                if made is None:
                    continue
                sums[lang] = sums.get(lang, np.zeros(DIMS, np.float64)) + unit(made)
                counts[lang] = counts.get(lang, 0) + 1
        names = sorted(sums)
        yield pa.RecordBatch.from_pydict(
            {"lang": names, "n": [counts[k] for k in names], "bundle": [sums[k].tobytes() for k in names]},
            schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("bundle", pa.binary())]),
        )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, np.float64) for b in group["bundle"]], axis=0)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "n": [int(group["n"].sum())], "bundle": [total.tobytes()]})

    merged = rows.mapInArrow(partial, schema).groupBy("lang").applyInPandas(merge, schema)
    found = merged.limit(MAX_LANGS + 1).collect()  # one pass over the texts, a bounded result
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    return {r["lang"]: unit(np.frombuffer(r["bundle"], np.float64)).astype(np.float32) for r in found}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``; score is the cosine to the nearest
    prototype, at least 0. Without prototypes every text is ``und``."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIMS), np.float32)
    text_name = free_name(docs, "text_")

    def rows(cols: list[list]) -> list[list]:
        ids, texts = cols
        langs, scores = [], []
        for text in texts:
            made = profile(text)
            if made is None or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            near = matrix @ unit(made)
            best = int(np.argmax(near))
            langs.append(names[best])
            scores.append(float(min(1.0, max(0.0, near[best]))))
        return [ids, langs, scores]

    id_type = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col), F.col(text_col).cast("string").alias(text_name)]
    return map_texts(docs, columns, f"id {id_type}, lang_pred string, score double", rows)
