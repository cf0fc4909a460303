"""The conversation prefix trie beside a trie built by hand from the contract."""

import hashlib
import random
import zlib

import pytest

from txnrisk.llm import prefix_trie as T
from txnrisk.llm.queries import op13_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    ordered = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, v in convs.items()}
    rebuilt = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = ordered.get(c - c % 100 if c >= 0 else c - (-((-c) % 100)), [])
        rebuilt[c] = base[:h] + own[h:]
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    own_saved = {k: (len(v) - 1) * (len(k[-1][1]) if k else 0) for k, v in members.items()}

    def total(key):
        leaves, saved = (0 if children.get(key) else 1), own_saved[key]
        for child in children.get(key, []):
            a, b = total(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for key, mem in members.items():
        ends = sorted(c for c in mem if len(rebuilt[c]) == len(key))
        leaves, saved = total(key)
        out.append((min(mem), len(key), min(members[key[:-1]]) if key else None, len(mem), len(children.get(key, [])),
                    leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0], r[3], r[6]))


def spark_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[1], r[0], r[3], r[6]))


def make(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in sorted(rng.sample(range(0, 400), convs)):
        for t in range(rng.randrange(0, 8)):
            rows.append((c, rng.choice([t, t, None, t + 1]), rng.choice(["user", "assistant", None]),
                         rng.choice(["hi", "yes", "no", "", None, "é😀", "long " * 30])))
    rows += [(None, 1, "user", "lost"), rows[0], rows[0]] if rows else []
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("weight", [3, T.SHARD_WEIGHT])
def test_trie_equals_brute_force(spark, seed, weight):
    rows = random_rows(seed)
    assert spark_rows(T.prefix_trie(make(spark, rows), weight=weight)) == brute(rows)


def test_one_long_conversation_in_small_shards(spark):
    rows = [(5, t, "user" if t % 2 else "assistant", f"t{t % 7}") for t in range(300)]
    rows += [(100, 0, "user", "x"), (101, 0, "user", "x"), (200, None, None, None)]
    assert spark_rows(T.prefix_trie(make(spark, rows), weight=16)) == brute(rows)


def test_edges(spark):
    assert T.prefix_trie(make(spark, []), weight=4).count() == 0
    rows = [(7, 1, "user", "a"), (7, 1, "user", "a"), (None, 2, "x", "y")]
    assert spark_rows(T.prefix_trie(make(spark, rows))) == brute(rows)
    extra = make(spark, rows).withColumn("k1", T.F.lit(9)).withColumn("pos", T.F.lit(1))
    assert spark_rows(T.prefix_trie(extra)) == brute(rows)


def test_query_on_table(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert spark_rows(op13_prefix_trie(spark, folder)) == brute(rows)


def test_small_blocks_give_the_same_trie(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    rows = [(5, t, "user", f"t{t % 5}") for t in range(120)] + [(105, t, "user", f"t{t % 5}") for t in range(30)]
    rows += [(100, 0, "user", "x"), (101, None, None, None), (7, 3, "a", "b")] + random_rows(4, convs=20)
    assert spark_rows(T.prefix_trie(make(spark, rows), weight=9)) == brute(rows)
