"""Fill-in-middle beside a plain regular-expression cut, and its SQL twin."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.llm import fill_in_middle as fim
from txnrisk.llm.sql import oracle_sql

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "a", " a ", "a\n\n", "x<P>y", "<M>", "é😀 z", "\t\x0b\x0c\r", "w " * 5000, "ab" * 20000]


def plain(doc_id, text):
    text = text or ""
    toks = TOKEN.findall(text)
    n = len(toks)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(toks[:a]), "".join(toks[a:b]), "".join(toks[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def random_texts(count, seed=3):
    rng = random.Random(seed)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "é", "😀", "\x0b", "x y"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(count)]


@pytest.mark.parametrize("error", [0, 1, 4, 32])
def test_rank_index_is_exact(error):
    for text in random_texts(300) + [t or "" for t in ODD]:
        offsets = fim.boundaries(text)
        assert offsets.tolist() == np.cumsum([0] + [len(t) for t in TOKEN.findall(text)]).tolist()
        index = fim.RankIndex(offsets, error)
        assert [index.offset(k) for k in range(offsets.size)] == offsets.tolist()
        assert np.abs(index.residuals).max() <= error + 1


def test_segments_are_few_on_regular_offsets():
    offsets = fim.boundaries("word " * 100_000)
    assert fim.RankIndex(offsets).starts.size == 1


def test_transform_equals_plain_cut_and_restores():
    texts = random_texts(1500) + ODD
    for i, text in enumerate(texts):
        got = fim.transform(i, text)
        assert got == plain(i, text)
        assert fim.restore(got[4], got[1]) == (text or "")
    assert fim.transform(None, "a b c") == plain(None, "a b c")


def test_spark_rows_restored_and_extra_columns(spark):
    texts = random_texts(200) + ODD
    rows = [(i % 150 if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(5, "same text", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, output long").withColumn("kept", F.lit(1))
    made = fim.fill_in_middle(docs, keep=("output", "kept")).withColumn("back", fim.restored())
    got = made.collect()
    assert len(got) == len(rows) and all(r["kept"]["kept"] == 1 for r in got)
    by_extra = {}
    for r in got:
        by_extra.setdefault(r["kept"]["output"], []).append(r)
    for doc_id, text, extra in rows:
        found = [r for r in by_extra[extra] if r["output"] == plain(doc_id, text)[4]]
        assert found and found[0]["back"] == (text or "")
        assert (found[0]["n"], found[0]["form"], found[0]["prefix_chars"]) == plain(doc_id, text)[:3]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_sql_twin_agrees(spark, tmp_path):
    texts = random_texts(300) + ODD
    rows = [(i, t) for i, t in enumerate(texts)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    twin = {r[0]: r[1:] for r in con.sql(oracle_sql()["op11_fill_in_middle"]).fetchall()}
    for i, text in rows:
        n, form, pc, mc, out = plain(i, text)
        want = (n, form, pc, mc, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert twin[i] == want
