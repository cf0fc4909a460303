"""Document fingerprints as homomorphic multiset hashes of paragraphs.

A paragraph (the text between two line feeds) hashes to a wide vector: 8 lanes of 64 bits from a
cryptographic digest, and 128 lanes of 32 bits that count its three-word windows with signs. A fingerprint is
the lane-wise sum over all paragraphs modulo 2**64 and 2**32. A window takes two bytes at least, so no text that
Spark can hold (2 GB) has a count of 2**31. Sums don't depend on the order
of paragraphs, so texts with the same paragraphs have equal fingerprints; a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest of the text. Texts that share most windows have nearly parallel
count lanes, whose cosine is the likeness of two fingerprints.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.neighbours import map_with_next
from txnrisk.llm.texts import map_texts

WIDE = 8
COUNT = 128
GRAM = 3
SEED = 9
AT_ONCE = 1 << 16


@dataclass
class Vector:
    wide: np.ndarray  # uint64
    count: np.ndarray  # uint32

    def __add__(self, other: Vector) -> Vector:
        return Vector(self.wide + other.wide, self.count + other.count)

    def __sub__(self, other: Vector) -> Vector:
        return Vector(self.wide - other.wide, self.count - other.count)

    def to_bytes(self) -> bytes:
        return self.wide.astype("<u8").tobytes() + self.count.astype("<u4").tobytes()


def from_bytes(data: bytes) -> Vector:
    at = 8 * WIDE
    return Vector(np.frombuffer(data[:at], "<u8"), np.frombuffer(data[at:], "<u4"))


def vector_of(paragraphs: list[bytes]) -> Vector:
    """Sum of the vectors of paragraphs; none give the zero vector."""
    wide = np.zeros(WIDE, np.uint64)
    digests = b"".join([hashlib.blake2b(p, digest_size=8 * WIDE).digest() for p in paragraphs])
    wide += np.frombuffer(digests, "<u8").reshape(-1, WIDE).sum(axis=0, dtype=np.uint64)
    count = np.zeros(COUNT, np.int64)
    windows = _windows(paragraphs)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(windows), AT_ONCE):
        part = windows[at : at + AT_ONCE]
        h = np.fromiter((digest(w, SEED) for w in part), np.uint64, len(part))
        sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
        count += np.bincount((h % np.uint64(COUNT)).astype(np.int64), sign, COUNT).astype(np.int64)
    return Vector(wide, count.astype(np.uint32))


def _windows(paragraphs: list[bytes]) -> list[bytes]:
    """Space-joined windows of GRAM words inside each paragraph; a shorter paragraph is one window."""
    split = [p.split() for p in paragraphs]
    words = [w for some in split for w in some]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = np.cumsum(sizes)
    first = last - sizes
    whole = (sizes > 0) & (sizes < GRAM)
    begin = np.arange(len(words))
    paragraph = np.repeat(np.arange(len(sizes)), sizes)
    begin = begin[begin + GRAM <= last[paragraph]]
    froms = np.concatenate((starts[begin], starts[first[whole]]))
    tos = np.concatenate((ends[begin + GRAM - 1], ends[last[whole] - 1]))
    return [joined[s:e] for s, e in zip(froms.tolist(), tos.tolist())]


def text_vector(text: str | None) -> Vector:
    """Fingerprint of a text; null and empty texts have one empty paragraph."""
    return vector_of((text or "").encode().split(b"\n"))


def edited_vector(vector: Vector, text: str, keep: int, tail: str) -> Vector:
    """Fingerprint of ``text[:keep] + tail`` from that of ``text``: the paragraphs from the cut on are
    deleted and the new ones inserted."""
    cut = text.rfind("\n", 0, keep) + 1
    gone = text[cut:].encode().split(b"\n")
    new = (text[cut:keep] + tail).encode().split(b"\n")
    return vector - vector_of(gone) + vector_of(new)


def likeness(a: Vector, b: Vector) -> float:
    """0 to 1: 1 for equal fingerprints, else the cosine of the count lanes, negative ones as 0."""
    if np.array_equal(a.wide, b.wide):
        return 1.0
    x, y = a.count.astype(np.int32).astype(float), b.count.astype(np.int32).astype(float)
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(max(x @ y / norm, 0.0), 1.0)) if norm else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint binary) for every row; repeated rows stay, an empty table gives no rows.

    A null text is the empty text (one empty paragraph); a null id is kept as null.
    Whole texts are read, however long: the cost grows with the number of paragraphs.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(columns: list[list]) -> list[list]:
        ids, texts = columns
        return [ids, [text_vector(t).to_bytes() for t in texts]]

    source = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    return map_texts(docs, source, f"id {kind}, fingerprint binary", rows)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against an edit of itself and against its successor in id order.

    The edit replaces the last quarter of the characters (rounded down) by as many, or all, from the
    start of the next document; its fingerprint is derived from the document's by deletion and
    insertion. (id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited,
    near_next); order, ties and nulls as in ``map_with_next``. Whole texts are compared, however
    long; a task holds two documents at a time.
    """

    def prepare(text: str) -> tuple[str, Vector]:
        return text, text_vector(text)

    def compare(own: tuple[str, Vector], after: tuple[str, Vector]) -> tuple:
        text, vector = own
        change = len(text) // 4
        keep, tail = len(text) - change, after[0][:change]
        digest = hashlib.sha256((text[:keep] + tail).encode()).hexdigest()
        edited = edited_vector(vector, text, keep, tail)
        near = likeness(vector, edited), likeness(vector, after[1])
        return len(text), digest, vector.to_bytes(), edited.to_bytes(), *near

    schema = (
        "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
        "near_edited double, near_next double"
    )
    return map_with_next(docs, prepare, compare, schema, id_col, text_col)
