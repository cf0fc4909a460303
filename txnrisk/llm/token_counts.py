"""Token counts of a SentencePiece BPE model by rank-synchronous merging.

Texts are cut into pre-tokens that no piece crosses. Distinct pre-tokens of a batch are held as one
ragged array of symbols; in each round every pre-token applies its lowest-rank pair, all at once, and the
symbols that survive are counted. Characters outside the vocabulary count their UTF-8 bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.chunks import ChunkTable
from txnrisk.llm.merges import Pairs, merge_all
from txnrisk.llm.piece_models import chunks_of, code_points_of, load_pieces, utf8_sizes
from txnrisk.llm.texts import map_texts


class PieceCounter:
    """Counts tokens of texts as the model's own library does."""

    def __init__(self, path: str) -> None:
        pieces = load_pieces(path)
        ids = {pieces.texts[i]: i for i in pieces.normal}
        size = len(pieces.texts)
        symbols = dict(ids)  # every character of a piece is a symbol, a piece or not
        for text in ids:
            for c in text:
                symbols.setdefault(c, size + len(symbols))
        base = size + len(symbols) + 8
        self.symbol = np.full(0x110000, -1, np.int32)
        for text, s in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = s
        self.foreign = base - 5  # + UTF-8 size: symbols of characters that no piece holds
        worst = {score: r for r, score in enumerate(sorted({pieces.scores[i] for i in ids.values()}, reverse=True))}
        rows = [
            (symbols[text[:cut]], symbols[text[cut:]], worst[pieces.scores[i]], i)
            for text, i in ids.items()
            for cut in range(1, len(text))
            if text[:cut] in symbols and text[cut:] in symbols
        ]
        self.pairs = Pairs(*map(list, zip(*rows)), symbols=base)
        weight = np.ones(base, np.int64)  # tokens of a surviving symbol
        for text, s in symbols.items():
            if text not in ids:
                weight[s] = len(text.encode())
        weight[self.foreign :] = np.arange(base - self.foreign)
        self.weight = weight
        self.table = ChunkTable(self._solve)

    def _solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, sizes = code_points_of(chunks)
        symbols = self.symbol[points].astype(np.int64)
        outside = symbols < 0
        symbols[outside] = self.foreign + utf8_sizes(points[outside])
        left, sizes = merge_all(symbols, sizes, self.pairs)
        ends = np.cumsum(sizes)
        total = np.concatenate(([0], np.cumsum(self.weight[left])))
        return (total[ends] - total[ends - sizes]).astype(np.int32), np.ones(len(sizes), np.int64)

    def counts(self, texts: list[str | None]) -> list[int]:
        self.table.start()
        rows = [self.table.rows(chunks_of(t or "")) for t in texts]
        self.table.settle()
        return [int(self.table.flat[r].sum(dtype=np.int64)) for r in rows]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One per worker process."""
    return PieceCounter(path)


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes long, n_tokens long) for every row; a null or empty text has no tokens.

    Whole texts are counted. Repeated rows stay; other columns are not read; an empty table gives no rows.
    ``path`` names a model file that every worker has.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")

    def rows(columns: list[list]) -> list[list]:
        ids, sizes, texts = columns
        return [ids, sizes, counter(path).counts(texts)]

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return map_texts(
        docs,
        [F.col(id_col).alias("id"), size.alias("n_bytes"), text.alias("text")],
        f"id {kind}, n_bytes long, n_tokens long",
        rows,
    )
