"""Best-scoring cuts beside an exhaustive search, and exact round trips."""

import random

import pytest

from txnrisk.llm import unigram
from txnrisk.llm.piece_models import SPACE, load_pieces
from txnrisk.llm.queries import PIECES

ODD = [None, "", " ", "  a ", "▁", "a▁b ▁▁", "a\nb\t", "😀 é漢梦", "\x00", "<s> </s>", "aa" * 2000, "ﬁ İ ß", " x" * 3000]


@pytest.fixture(scope="module")
def model():
    return unigram.unigram(PIECES)


def plain_best(word, scores, foreign):
    """Best score by looking at every cut of every prefix."""
    best = [0.0]
    for end in range(1, len(word) + 1):
        options = [best[s] + scores[word[s:end]] for s in range(end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            options.append(best[end - 1] + foreign)
        best.append(max(options, default=float("-inf")))
    return best[-1]


def test_scores_are_best(model):
    pieces = load_pieces(PIECES)
    scores = {pieces.texts[i]: pieces.scores[i] for i in pieces.normal}
    rng = random.Random(6)
    for _ in range(1500):
        word = SPACE * rng.randrange(1, 3) + "".join(rng.choice("thenaioérsq漢😀") for _ in range(rng.randrange(12)))
        score, ids = model.best(word)
        assert score == plain_best(word, scores, model.foreign)
        told = sum(pieces.scores[i] if i in set(pieces.normal) else 0 for i in ids) if "😀" not in word else None
        if told is not None and all(i in set(pieces.normal) for i in ids):
            assert told == score
            assert "".join(pieces.texts[i] for i in ids) == word


def test_round_trip(model):
    rng = random.Random(7)
    letters = "the and of▁  \n\té漢😀\x00ÿ"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(2000)]
    for text, ids in zip(texts, model.encode(texts)):
        assert unigram.decoder(PIECES).decode(ids) == (text or "")


def test_columns(spark):
    rows = [(i, t, [1]) for i, t in enumerate(ODD)] + [(0, None, [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    coded = unigram.encode_documents(docs.withColumn("more", docs.doc_id * 2), PIECES, keep=("more",))
    back = unigram.decode_documents(coded, PIECES, keep=("more",)).collect()
    assert sorted(back) == sorted((i, t or "", 2 * i) for i, t, _ in rows)
    assert unigram.encode_documents(docs.limit(0), PIECES).count() == 0
