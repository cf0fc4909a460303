"""Packing token sequences into windows of a fixed size, online and in bounded space.

Every partition keeps a fixed number of open windows. A piece goes into the open window it fills best; if it
fits none, the fullest window is emitted (topped up with the piece's first ids if more than ``slack`` would be
padding) and the rest of the piece opens a new one. Windows still open at a partition's end are
leftovers: their pieces are packed again in ever fewer partitions, each holding a bounded number, and the very
last ones are poured into full windows and a tail cut at powers of two, which needs no padding.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from txnrisk.llm.chunks import ChunkTable, blocks_of
from txnrisk.llm.merges import Pairs, merge_all
from txnrisk.llm.texts import pieces_of
from txnrisk.sources.workspace import settled

FAN_IN = 8  # partitions whose leftovers meet in one
_PLAIN_END = 0x250  # characters from here on are left to the tokenizer library
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")  # str.split breaks here, the tokenizer doesn't
_WHITE = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)


class WordTokens:
    """Ids of a lower-casing, white-space-dropping word BPE, equal to the tokenizers library's.

    White space always separates tokens, so a text's ids are those of its chunks between white space. Chunks
    of plain Latin letters are merged in batches; all others go through the library.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        shape = (
            [n["type"] for n in told["normalizer"]["normalizers"]],
            [p["type"] for p in told["pre_tokenizer"]["pretokenizers"]],
            told["model"]["type"],
            told["model"]["end_of_word_suffix"],
        )
        if shape != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE", "</w>"):
            raise ValueError("not a tokenizer of lower-cased words")
        self.words = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        ids = told["model"]["vocab"]
        pairs = [(p if isinstance(p, list) else p.split(" ")) for p in told["model"]["merges"]]
        self.pairs = Pairs(
            [ids[a] for a, _ in pairs],
            [ids[b] for _, b in pairs],
            range(len(pairs)),
            [ids[a + b] for a, b in pairs],
            symbols=1 + max(ids.values()),
        )
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters])
        self.last = np.array([ids[c + "</w>"] for c in letters])
        self.table = ChunkTable(self._solve)

    def _solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        owner: list[int] = []
        other: dict[int, list[int]] = {}
        for i, chunk in enumerate(chunks):
            if not chunk.isascii() and max(chunk) >= chr(_PLAIN_END) or "<|" in chunk:
                other[i] = self.library.encode(chunk, add_special_tokens=False).ids
                continue
            if not chunk.isascii():
                chunk = unicodedata.normalize("NFC", chunk)
            found = self.words.findall(chunk.lower())
            words += [w.encode() for w in found]
            owner += [i] * len(found)
        symbols, sizes = self._letters(words)
        flat, sizes = merge_all(symbols, sizes, self.pairs)
        of = np.repeat(np.asarray(owner, np.int64), sizes)
        if other:
            flat = np.concatenate([flat, *(np.asarray(v, np.int64) for v in other.values())])
            of = np.concatenate([of, *(np.full(len(v), i) for i, v in other.items())])
            order = np.argsort(of, kind="stable")
            flat, of = flat[order], of[order]
        return flat.astype(np.int32), np.bincount(of, minlength=len(chunks)).astype(np.int64)

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        octets = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.inner[octets]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[octets[ends]]
        return symbols, sizes

    @staticmethod
    def _chunks(text: str) -> Iterator[list[str]]:
        for block in blocks_of(text):
            if _SEPARATORS.search(block):
                yield [c for c in _WHITE.split(block) if c]
            else:
                yield block.split()

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        self.table.start()
        rows = [self.table.rows(self._chunks(t or "")) for t in texts]
        self.table.settle()
        return [self.table.ids(r) for r in rows]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others
    for characters from U+0100 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
    return [moved.get(b, chr(b)) for b in range(256)]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per worker process."""
    return WordTokens(path)


@dataclass
class Piece:
    """A stretch of one document's ids."""

    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        tail = Piece(self.doc, self.start + at, self.ids[at:], self.doc_tokens)
        return Piece(self.doc, self.start, self.ids[:at], self.doc_tokens), tail


@dataclass
class Window:
    used: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece.ids)


class Packer:
    """Best-fit into a fixed number of open windows; memory is bounded by these."""

    def __init__(self, size: int, windows: int, slack: int) -> None:
        self.size, self.windows, self.slack = size, windows, slack
        self.open: list[Window] = []

    def put(self, piece: Piece) -> Iterator[Window]:
        """Places a piece; yields the windows that are done."""
        while len(piece.ids) > self.size:
            head, piece = piece.cut(self.size)
            yield Window(self.size, [head])
        fits = [w for w in self.open if w.used + len(piece.ids) <= self.size]
        if not fits and len(self.open) >= self.windows:
            fullest = max(self.open, key=lambda w: w.used)
            self.open.remove(fullest)
            if self.size - fullest.used > self.slack:
                head, piece = piece.cut(self.size - fullest.used)
                fullest.add(head)
                fits = [w for w in self.open if w.used + len(piece.ids) <= self.size]
            yield fullest
        if fits:
            best = max(fits, key=lambda w: w.used)
        else:
            best = Window()
            self.open.append(best)
        best.add(piece)
        if best.used == self.size:
            self.open.remove(best)
            yield best

    def pour(self) -> Iterator[Window]:
        """The last leftovers as full windows and a tail of windows at powers of two."""
        pieces = [p for w in self.open for p in w.pieces]
        self.open = []
        total = sum(len(p.ids) for p in pieces)
        room = [self.size] * (total // self.size)
        tail = total % self.size
        room += [1 << i for i in reversed(range(tail.bit_length())) if tail >> i & 1]
        for size in room:
            window = Window()
            while window.used < size:
                piece = pieces.pop(0)
                if window.used + len(piece.ids) > size:
                    piece, rest = piece.cut(size - window.used)
                    pieces.insert(0, rest)
                window.add(piece)
            yield window


def pack(
    docs: DataFrame,
    tokens: Callable[[list[str | None]], list[np.ndarray]],
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    windows: int = 16,
    slack: int = 32,
) -> DataFrame:
    """Pieces of all documents: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``tokens`` turns texts into id arrays; ``end_id`` is appended to every document, so a null or empty
    text is one id. ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers. Every id lies
    in exactly one piece; a sequence's offsets run from 0 without gaps and its length is at most ``size``. Repeated
    rows are packed each on its own; other columns are not read; an empty table gives no rows.
    Which documents share a sequence depends on how rows were read. A very long document is cut into
    as many pieces as it needs; its ids are never truncated.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long, part int, done boolean"
    )

    def read_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[Piece]]:
        for batch in pieces_of(batches):
            names, texts = (c.to_pylist() for c in batch.columns)
            made = []
            for doc, ids in zip(names, tokens(texts)):
                whole = np.append(ids, end_id).astype("<u4")
                made.append(Piece(doc, 0, whole, len(whole)))
            yield made

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = settled(source.mapInArrow(_packed(schema, read_texts, size, windows, slack, 0), schema))
    done = packed.filter("done")
    round_no = 1
    parts = _parts(packed)
    while parts:
        parts = -(-parts // FAN_IN)
        left = packed.filter("NOT done").select("id", "start", "ids", "doc_tokens").repartition(parts)
        run = _packed(schema, _read_pieces, size, windows, slack, round_no, last=parts == 1)
        packed = settled(left.mapInArrow(run, schema))
        done = done.union(packed.filter("done"))
        parts = 0 if parts == 1 else parts
        round_no += 1
    return done.drop("part", "done")


def _parts(packed: DataFrame) -> int:
    """Number of partitions that have leftovers."""
    return packed.filter("NOT done").agg(F.count_distinct("part")).first()[0]


def _read_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[list[Piece]]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        yield [Piece(doc, start, np.frombuffer(ids, "<u4"), n) for doc, start, ids, n in zip(*columns)]


def _packed(schema: str, read, size: int, windows: int, slack: int, round_no: int, last: bool = False):
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(size, windows, slack)
        number = ((round_no << 26) + part) << 31

        def rows(some: Iterable[Window], done: bool) -> Iterator[tuple]:
            nonlocal number
            for window in some:
                offset = 0
                for p in window.pieces:
                    n = len(p.ids)
                    yield p.doc, p.start, n, p.ids.tobytes(), p.doc_tokens, number, offset, part, done
                    offset += n
                number += 1

        def batch(made: list[tuple]) -> pa.RecordBatch:
            columns = zip(*made) if made else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for pieces in read(batches):
            yield batch([r for p in pieces for r in rows(packer.put(p), True)])
        yield batch(list(rows(packer.pour(), True) if last else rows(packer.open, False)))

    return run
