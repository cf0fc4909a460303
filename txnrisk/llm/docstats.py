"""Statistics of one document, from its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from txnrisk.llm.texts import words_of

WINDOW = 5  # words of a window looked for twice
SYMBOLS = b"#*$%&|<>"
_KINDS = ("other", "inside", "white", "symbol", "upper", "lower", "digit", "mark")
_KIND = np.zeros(256, np.uint8)
_KIND[0x80:0xC0] = 1  # second and further bytes of a character
_KIND[list(b" \t\n\x0b\x0c\r")] = 2
_KIND[0x41:0x5B] = 4
_KIND[0x61:0x7B] = 5
_KIND[0x30:0x3A] = 6
_KIND[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = 7
_KIND[list(SYMBOLS)] = 3

#: counts, as the base rules name them
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: transformed statistics for the models, all finite for any text
FEATURES = (
    "log_words",
    "log_word_chars",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "marks_per_word",
    "digit_share",
    "distinct_share",
    "echo_share",
    "log_line_words",
)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more, first occurrences included. Exact."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    codes, base = ids[:n].astype(np.int64), distinct
    for i in range(1, window):
        if base * distinct >= 2**62:
            codes = np.unique(codes, return_inverse=True)[1]
            base = int(codes.max()) + 1
        codes, base = codes * distinct + ids[i : i + n], base * distinct
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(codes, np.unique(twice))
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[:n] += hit
    cover[window : window + n] -= hit
    return int(np.count_nonzero(np.cumsum(cover)))


def statistics(data: bytes | None) -> tuple[list[int], list[float]]:
    """(COUNTS, FEATURES) of a text; null counts as empty."""
    data = data or b""
    words = words_of(data)
    kinds = dict(zip(_KINDS, np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=len(_KINDS)).tolist()))
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    n_words = len(words)
    word_chars = len(data) - kinds["inside"] - kinds["white"]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(ids, len(numbers))
    counts = [n_words, word_chars, kinds["symbol"], dup_lines, repeat]
    some = max(n_words, 1)
    letters = max(kinds["upper"] + kinds["lower"], 1)
    features = [
        np.log1p(n_words),
        np.log1p(word_chars / some),
        np.sqrt(kinds["symbol"] / max(word_chars, 1)),
        np.sqrt(dup_lines / max(len(lines), 1)),
        np.sqrt(repeat / some),
        np.sqrt(kinds["upper"] / letters),
        np.sqrt(kinds["mark"] / some),
        np.sqrt(kinds["digit"] / max(word_chars, 1)),
        np.log1p(len(numbers)) / max(np.log1p(n_words), 1e-9) if n_words else 1.0,
        np.sqrt(np.count_nonzero(ids[1:] == ids[:-1]) / some),
        np.log1p(n_words / max(len(lines), 1)),
    ]
    return counts, [float(x) for x in features]
