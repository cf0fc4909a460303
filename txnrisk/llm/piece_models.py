"""SentencePiece vocabularies: pieces, scores, and the cut of a text into independent chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import sentencepiece

from txnrisk.llm.chunks import blocks_of

SPACE = "▁"  # stands for a space inside pieces
_CHUNKS = re.compile(f"{SPACE}+[^{SPACE}]*")


@dataclass
class Pieces:
    """A vocabulary as plain lists; ``normal`` pieces match text, ``octets`` stand for single bytes."""

    texts: list[str]
    scores: list[float]
    normal: list[int]
    octets: dict[int, int]
    unknown: int


def load_pieces(path: str) -> Pieces:
    """Reads a model whose texts are kept as they are but for spaces and a leading one.

    Raises for other normalisers and for pieces that hold a space after another character: the
    cut into chunks would not be exact for these.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "Ä  ﬁ x "
    if sentencepiece.SentencePieceNormalizer(model_file=path).normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("the model changes texts in a way that is not supported")
    n = model.vocab_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(re.search(f"[^{SPACE}]{SPACE}", texts[i]) for i in normal):
        raise ValueError("pieces over several words are not supported")
    octets = {int(texts[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
    return Pieces(texts, [model.get_score(i) for i in range(n)], normal, octets, model.unk_id())


def chunks_of(text: str) -> Iterator[list[str]]:
    """Chunks of a text without their first space sign; no piece reaches from one into the next.

    A chunk is a run of spaces with the characters up to the next space. The text has a space put
    before it, so every chunk begins with one.
    """
    if not text:
        return
    for block in blocks_of(text):
        if SPACE in block or "  " in block or block[0:1] in ("", " ") or block[-1] == " ":
            yield [c[1:] for c in _CHUNKS.findall(SPACE + block.replace(" ", SPACE))]
        else:
            yield block.split(" ")


def code_points_of(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of chunks with their leading space sign, flat, and their numbers."""
    whole = SPACE + SPACE.join(chunks)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32), sizes


def utf8_sizes(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
