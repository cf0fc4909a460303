"""SentencePiece encoding as the best-scoring cut into pieces, and exact decoding.

An Aho-Corasick automaton over all pieces reads a text once. At every character it reports, along its output
links, each piece that ends there, and each report relaxes the best score of that place; so one pass is the whole
Viterbi search. No piece reaches over the start of a word, so words are searched once each and remembered.
Characters without a piece become their UTF-8 bytes.
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.chunks import ChunkTable
from txnrisk.llm.piece_models import SPACE, chunks_of, load_pieces
from txnrisk.llm.texts import map_texts

LITERAL = "\udfff"  # stands for the space sign itself where a text holds it; no text can hold this
PENALTY = 10.0


class Unigram:
    """Encodes with the pieces and scores of a SentencePiece model."""

    def __init__(self, path: str) -> None:
        pieces = load_pieces(path)
        self.octets = [pieces.octets[i] for i in range(256)]
        self.automaton = ahocorasick.Automaton()
        for i in pieces.normal:
            text = pieces.texts[i]
            self.automaton.add_word(text, (i, len(text), pieces.scores[i]))
        self.automaton.make_automaton()
        usual = [s for i in pieces.normal if (s := pieces.scores[i]) > -1e8]
        self.foreign = min(usual) - PENALTY
        self.table = ChunkTable(self._solve, limit=1_000_000)

    def best(self, word: str) -> tuple[float, list[int]]:
        """Score and ids of the best cut of a word; of equal cuts, the one with the longer last piece."""
        size = len(word)
        score = [0.0] + [-math.inf] * size
        start = [0] * (size + 1)  # where the best cut's last part begins
        part = [-1] * (size + 1)  # its piece; none: a character as bytes
        foreign, at, single = self.foreign, 0, False
        for end, (piece, length, worth) in self.automaton.iter(word):
            while at < end:  # characters passed: without a piece of their own they may be bytes
                if not single and score[at] + foreign > score[at + 1]:
                    score[at + 1], start[at + 1], part[at + 1] = score[at] + foreign, at, -1
                at, single = at + 1, False
            if length == 1:
                single = True
            begin = end + 1 - length
            value = score[begin] + worth
            if value > score[end + 1]:
                score[end + 1], start[end + 1], part[end + 1] = value, begin, piece
        while at < size:
            if not single and score[at] + foreign > score[at + 1]:
                score[at + 1], start[at + 1], part[at + 1] = score[at] + foreign, at, -1
            at, single = at + 1, False
        ids: list[int] = []
        place = size
        while place:
            if part[place] >= 0:
                ids.append(part[place])
            else:
                c = word[start[place] : place].replace(LITERAL, SPACE)
                ids += [self.octets[b] for b in reversed(c.encode())]
            place = start[place]
        ids.reverse()
        return score[size], ids

    def _solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.best(SPACE + c)[1] for c in chunks]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        self.table.start()
        rows = [self.table.rows(chunks_of(t.replace(SPACE, LITERAL) if t else "")) for t in texts]
        self.table.settle()
        return [self.table.ids(r) for r in rows]


class PieceDecoder:
    """Texts of ids; needs the pieces alone."""

    def __init__(self, path: str) -> None:
        pieces = load_pieces(path)
        self.bytes = [b""] * len(pieces.texts)  # control ids stand for nothing
        for i in pieces.normal:
            self.bytes[i] = pieces.texts[i].replace(SPACE, " ").encode()
        for octet, i in pieces.octets.items():
            self.bytes[i] = bytes([octet])

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids; the space that encoding puts first is taken off."""
        data = b"".join([self.bytes[i] for i in ids])
        return data.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    """One per worker process."""
    return Unigram(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> PieceDecoder:
    """One per worker process."""
    return PieceDecoder(path)


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, ids array<int>, the columns of ``keep``) of whole texts.

    Null and empty texts have no ids. Repeated rows stay, an empty table gives no rows. Very long texts
    are encoded whole, in short slices cut only before a run of spaces.
    """

    def rows(columns: list[list]) -> list[list]:
        ids, texts, *kept = columns
        return [ids, unigram(path).encode(texts), *kept]

    source = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *map(F.col, keep)]
    return map_texts(docs, source, _schema(docs, id_col, "ids array<int>", keep), rows)


def decode_documents(
    coded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, text, the columns of ``keep``); null ids give an empty text, ids outside the vocabulary fail."""

    def rows(columns: list[list]) -> list[list]:
        names, ids, *kept = columns
        return [names, [decoder(path).decode(i or []) for i in ids], *kept]

    source = [F.col(id_col).alias("id"), F.col(ids_col), *map(F.col, keep)]
    return map_texts(coded, source, _schema(coded, id_col, "text string", keep), rows)


def _schema(df: DataFrame, id_col: str, made: str, keep: tuple[str, ...]) -> str:
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    return ", ".join([f"id {kinds[id_col]}", made, *(f"{c} {kinds[c]}" for c in keep)])
