"""Fill-in-middle: a text cut at two token boundaries and rearranged around sentinel strings.

The boundaries of a text are found through a piecewise-linear learned rank index: the end offsets
of all tokens (rank -> code point offset) are covered by segments whose line predicts every
offset within ``error`` code points; the residual of each rank is stored beside them, so a cut is
predicted from its segment and corrected exactly. Each text is one row; whole texts go through, in
short record batches per task.

Defined results: a null text is the empty text. An empty text, or one that holds a sentinel,
stays plain. Repeated rows and equal ids give equal results, since the cut depends on the id only.
Very long texts cost time and memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.llm.texts import free_name, map_texts

# Fixed values of the contract: sentinels, the salt of the cut hash and the form shares.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "42:"
PLAIN_AT = 50  # h3 % 100 at or above this: plain
SPM_BELOW = 80  # h4 % 100 below this: suffix first
ERROR = 32  # most code points a segment's line may miss an offset by

SPACE = np.zeros(0x110000, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SENTINEL = re.compile("<P>|<S>|<M>")


def boundaries(text: str) -> np.ndarray:
    """End offsets (code points) of the tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``.

    A token ends where a run of other characters ends, and at the end of a text that ends in
    spaces. Offset 0 (rank 0) leads.
    """
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if points.size == 0:
        return np.zeros(1, dtype=np.int64)
    space = SPACE[points]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate(([0], ends, [points.size])).astype(np.int64)


def fit_segments(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments over (rank, offset): first ranks, first offsets and slopes, each line within ``error``.

    Greedy shrinking cone: a segment grows while some slope through its first point keeps every
    later point within ``error``; the slope taken is the middle of the cone.
    """
    starts, bases, slopes = [], [], []
    n = offsets.size
    at = 0
    while at < n:
        x0, y0 = at, offsets[at]
        low, high = -np.inf, np.inf
        end = at + 1
        while end < n:
            dx = end - x0
            dy = offsets[end] - y0
            new_low, new_high = max(low, (dy - error) / dx), min(high, (dy + error) / dx)
            if new_low > new_high:
                break
            low, high = new_low, new_high
            end += 1
        slope = 0.0 if end == at + 1 else (low + high) / 2
        starts.append(x0)
        bases.append(y0)
        slopes.append(slope)
        at = end
    return np.array(starts, np.int64), np.array(bases, np.int64), np.array(slopes, np.float64)


class RankIndex:
    """Offsets of token boundaries by rank: segments predict, stored residuals correct exactly."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        self.starts, self.bases, self.slopes = fit_segments(offsets, error)
        self.residuals = (offsets - self._predict(np.arange(offsets.size))).astype(np.int16)
        self.n = offsets.size - 1

    def _predict(self, ranks: np.ndarray) -> np.ndarray:
        seg = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[seg] + np.rint(self.slopes[seg] * (ranks - self.starts[seg])).astype(np.int64)

    def offset(self, rank: int) -> int:
        """Code point offset after ``rank`` tokens."""
        ranks = np.array([rank])
        return int(self._predict(ranks)[0] + self.residuals[rank])


def cut_hashes(doc_id) -> tuple[int, int, int, int]:
    """h1..h4: the first four 8-digit groups of sha256('42:' + id), unsigned."""
    digest = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i * 8 : i * 8 + 8], 16) for i in range(4))


def transform(doc_id, text: str | None) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    offsets = boundaries(text)
    n = offsets.size - 1
    h1, h2, h3, h4 = cut_hashes(doc_id)
    if not text or SENTINEL.search(text) or h3 % 100 >= PLAIN_AT:
        return n, "plain", None, None, text
    index = RankIndex(offsets)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    left, right = index.offset(a), index.offset(b)
    prefix, middle, suffix = text[:left], text[left:right], text[right:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", left, right - left, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", left, right - left, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text an output was made from."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, rest = output[len(PREFIX) :].split(SUFFIX, 1)
        suffix, middle = rest.split(MIDDLE, 1)
    else:
        suffix, rest = output[len(SUFFIX) :].split(PREFIX, 1)
        prefix, middle = rest.split(MIDDLE, 1)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Every row of ``docs``: (id, n, form, prefix_chars, middle_chars, output, kept).

    ``n`` tokens; ``form`` plain, psm or spm; ``prefix_chars`` and ``middle_chars`` in code points,
    null when plain. ``kept`` is a struct of the ``keep`` columns under their own names, so no name
    of the caller can clash with these. A null id is hashed as the empty text (``42:`` alone).
    """
    carried = [free_name(docs, f"keep{i}") for i in range(len(keep))]
    columns: list[Column] = [F.col(id_col), F.col(text_col).cast("string")]
    columns += [F.col(k).alias(c) for k, c in zip(keep, carried)]
    kept_types = "".join(f"`{c}` {docs.schema[k].dataType.simpleString()}, " for k, c in zip(keep, carried))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {kept_types}"
    schema += "n long, form string, prefix_chars long, middle_chars long, output string"

    def rows(cols: list[list]) -> list[list]:
        ids, texts, *rest = cols
        made = [transform(i, t) for i, t in zip(ids, texts)]
        return [ids, *rest, *(map(list, zip(*made)) if made else [[]] * 5)]

    made = map_texts(docs, columns, schema, rows)
    kept = F.struct(*[F.col(c).alias(k) for c, k in zip(carried, keep)]).alias("kept")
    return made.select("id", "n", "form", "prefix_chars", "middle_chars", "output", kept)


def restored(output: str = "output", form: str = "form") -> Column:
    """The original text rebuilt in Spark from an output and its form (sentinels never occur inside)."""
    out, kind = F.col(output), F.col(form)

    def parts(lead: str, second: str) -> tuple[Column, Column, Column]:
        first_rest = F.split(F.substring(out, len(lead) + 1, 1 << 30), second, 2)
        rest = F.split(first_rest.getItem(1), MIDDLE, 2)
        return first_rest.getItem(0), rest.getItem(0), rest.getItem(1)

    p_prefix, p_suffix, p_middle = parts(PREFIX, SUFFIX)
    s_suffix, s_prefix, s_middle = parts(SUFFIX, PREFIX)
    return (
        F.when(kind == "psm", F.concat(p_prefix, p_middle, p_suffix))
        .when(kind == "spm", F.concat(s_prefix, s_middle, s_suffix))
        .otherwise(out)
    )
