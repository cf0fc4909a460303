"""Token counts and packing beside the public libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from txnrisk.llm import packing, token_counts, unigram
from txnrisk.llm.merges import Pairs, merge_all, merge_long
from txnrisk.llm.queries import PIECES, WORD_BPE

ODD = [
    None, "", " ", "  ", "a", " a ", "a  b", "▁", "a▁b", "▁▁a ▁", "\n", "a\nb \n", "<s>", "</s> <unk> x", "\x00a\x00",
    "ﬁ Ä ü ß", "日本語テキスト 梦", "😀😀 x😀", "a" * 3000, "ab" * 900 + " c", " " * 100, "x" + " " * 9 + "y", "thethethe",
    "<|endoftext|>", "ab<|endoftext|>c <|startoftext|>x", "it's I'LL we've 's", "İstanbul ΣΑΣ Σ", "\x1c", "a\x1cb \x1fc",
    "é x", " ́a", "a b\u0085c", "1234 a1b2", "a_b __", "***!!", "ª º µ ¼½ ²³", "x​y",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    letters = "aeiou thnrsdlcAE''ß \n.▁<>|é漢😀\"0123\t_"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    dense = [c for c in letters if c not in " ▁\n\t"]
    made += ["".join(rng.choice(dense) for _ in range(rng.randrange(300, 900))) for _ in range(20)]
    return ODD + made


def test_counts_equal_the_library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.counter(PIECES).counts(texts) == [len(model.encode(t or "")) for t in texts]


def test_word_ids_equal_the_library(texts):
    library = Tokenizer.from_file(WORD_BPE)
    got = packing.word_tokens(WORD_BPE).ids(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_forgetting_and_long_texts_change_nothing(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    whole = token_counts.counter(PIECES).counts([text])
    fresh = token_counts.PieceCounter(PIECES)
    fresh.table.limit, fresh.table.at_once = 10, 7
    monkeypatch.setattr("txnrisk.llm.piece_models.blocks_of", lambda t: _short_blocks(t))
    assert [fresh.counts([text])[0] for _ in range(3)] == whole * 3


def test_runs_of_spaces_are_not_cut(monkeypatch):
    """Every run of spaces and space signs meets the end of a block at each of its places."""
    texts = ["x" * k + run + "def ghi" * 20 for k in range(30, 52) for run in ("   ", "       ", " ▁ ", "▁  ")]
    texts += [t.replace("▁", " ").replace("g", "   g") for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [x.tolist() for x in unigram.Unigram(PIECES).encode(texts)]
    monkeypatch.setattr("txnrisk.llm.piece_models.blocks_of", lambda t: _short_blocks(t))
    assert token_counts.PieceCounter(PIECES).counts(texts) == [len(model.encode(t)) for t in texts]
    assert [x.tolist() for x in unigram.Unigram(PIECES).encode(texts)] == ids


def _short_blocks(text):
    from txnrisk.llm.chunks import blocks_of

    return blocks_of(text, 50)


def test_both_ways_of_merging_agree():
    """Ranks that fall and rise at random, so that merges open better ones."""
    rng = random.Random(4)
    ranks = rng.sample(range(400), 20 * 20 // 2)
    pairs = Pairs(
        [rng.randrange(20) for _ in ranks], [rng.randrange(20) for _ in ranks], ranks,
        [rng.randrange(20) for _ in ranks], 20,
    )
    keep = np.concatenate(([True], pairs.keys[1:] != pairs.keys[:-1]))
    pairs.keys, pairs.rank, pairs.merged = pairs.keys[keep], pairs.rank[keep], pairs.merged[keep]
    rows = [[rng.randrange(20) for _ in range(rng.randrange(1, 60))] for _ in range(200)]
    flat, sizes = merge_all(np.concatenate(rows), np.array([len(r) for r in rows]), pairs)
    want = [merge_long(list(r), pairs) for r in rows]
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want


def test_count_query_columns(spark):
    rows = [(1, "a b", 7), (1, "a b", 8), (None, None, 9), (2, "", 1), (3, "ä " * 3000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(docs, PIECES).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


# --- packing ---------------------------------------------------------------------------------------


def check_packed(pieces, ids, size, repeated=()):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert p["length"] * 4 == len(p["ids"])
    assert set(by_doc) == set(ids)
    for doc, found in by_doc.items():
        if doc in repeated:
            continue
        found.sort(key=lambda p: p["start"])
        assert [p["start"] for p in found] == np.cumsum([0] + [p["length"] for p in found])[:-1].tolist()
        assert b"".join(bytes(p["ids"]) for p in found) == ids[doc].astype("<u4").tobytes()
        assert {p["doc_tokens"] for p in found} == {len(ids[doc])}
    padded = 0
    for found in by_sequence.values():
        found.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in found] == np.cumsum([0] + [p["length"] for p in found])[:-1].tolist()
        total = sum(p["length"] for p in found)
        assert 0 < total <= size
        padded += 0 if total & (total - 1) == 0 else size - total
    return padded


@pytest.mark.parametrize("partitions", [1, 3, 20])
def test_packing(spark, partitions):
    rng = random.Random(partitions)
    texts = {i: "z " * rng.choice([0, 1, 5, 63, 64, 100, 700]) for i in range(300)}
    texts[7] = None
    rows = [(i, t, 0, "s") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, sequence_id string").repartition(partitions)

    def tokens(some):
        return [np.arange(len((t or "").split()), dtype=np.int64) for t in some]

    got = packing.pack(docs, tokens, end_id=99, size=64, windows=4, slack=2).collect()
    ids = {i: np.append(np.arange(len((t or "").split())), 99) for i, t in texts.items()}
    padded = check_packed(got, ids, 64)
    assert padded <= 0.03 * sum(map(len, ids.values()))


def test_packing_edges(spark):
    def tokens(some):
        return [np.zeros(len((t or "").split()), np.int64) for t in some]

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokens, 2).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokens, 2, size=8).collect()
    ids = {1: np.array([0, 0, 2]), None: np.array([2]), 2: np.array([2])}
    assert check_packed(got, ids, 8, repeated={1}) == 0
    assert sum(p["length"] for p in got) == 8


def test_packing_query_checksums(spark):
    from txnrisk.llm.queries import packed_documents

    library = Tokenizer.from_file(WORD_BPE)
    texts = {1: "Hello, packed World!", 2: None, 3: "é" * 5000 + " tail <|endoftext|>"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for p in packed_documents(docs).collect():
        ids = np.array(library.encode(texts[p["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
        part = ids[p["start"] : p["start"] + p["length"]]
        assert (p["doc_tokens"], p["ids_crc32"]) == (len(ids), zlib.crc32(part.tobytes()))


def test_tokenizer_files_are_outside_the_repository():
    assert PIECES == public_tokenizers.path("piece_bpe_32k.model")
