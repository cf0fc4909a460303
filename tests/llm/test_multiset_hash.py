"""Multiset fingerprints: algebra, likeness, and successors in id order."""

import hashlib
import random

import numpy as np
import pytest

from txnrisk.llm import multiset_hash as M
from txnrisk.llm.neighbours import map_with_next


def random_text(rng, paragraphs=8):
    return "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(40))) for _ in range(paragraphs))


def same(a, b):
    return a.to_bytes() == b.to_bytes()


def test_order_insertion_and_deletion():
    rng = random.Random(1)
    parts = [p.encode() for p in random_text(rng, 12).split("\n")] + [b"", b"", b"one", b"one two"]
    whole = M.vector_of(parts)
    shuffled = list(parts)
    rng.shuffle(shuffled)
    assert same(whole, M.vector_of(shuffled))
    assert same(whole, sum((M.vector_of([p]) for p in parts[1:]), M.vector_of(parts[:1])))
    assert same(whole - M.vector_of(parts[3:5]), M.vector_of(parts[:3] + parts[5:]))
    assert not same(whole, M.vector_of(parts + [b""]))
    assert same(M.from_bytes(whole.to_bytes()), whole)


def test_edits_are_derived_exactly():
    rng = random.Random(2)
    for _ in range(200):
        text = random_text(rng, rng.randrange(1, 6))[: rng.randrange(400)] + rng.choice(["", "\n", "é\n漢"])
        keep, tail = rng.randrange(len(text) + 1), random_text(rng, 2)[: rng.randrange(30)]
        got = M.edited_vector(M.text_vector(text), text, keep, tail)
        assert same(got, M.text_vector(text[:keep] + tail))


def test_likeness_follows_shared_windows():
    rng = random.Random(3)
    for share in (0.0, 0.5, 0.75, 1.0):
        near = []
        for _ in range(30):
            words = [f"a{rng.randrange(10**6)}" for _ in range(400)]
            kept = int(400 * share)
            other = words[:kept] + [f"b{rng.randrange(10**6)}" for _ in range(400 - kept)]
            near.append(M.likeness(M.text_vector(" ".join(words)), M.text_vector(" ".join(other))))
        assert abs(np.mean(near) - share) < 0.06
    assert M.likeness(M.text_vector(None), M.text_vector("")) == 1.0
    assert M.likeness(M.text_vector(""), M.text_vector("a b c d")) == 0.0


def test_counts_beyond_16_bits():
    """One line 40,000 times against the same 30,000 times: the count lanes are parallel."""
    text = "0\n" * 40_000
    whole = M.text_vector(text)
    edited = M.edited_vector(whole, text, 60_000, " ".join(f"w{i}" for i in range(100)))
    assert M.likeness(whole, edited) > 0.99
    assert abs(int(whole.count.astype(np.int32)[np.argmax(np.abs(whole.count.astype(np.int32)))])) == 40_000


def plain(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    made = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, b, c = map(M.text_vector, (text, edited, after))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        made.append((i, len(text), digest, a.to_bytes(), b.to_bytes(), M.likeness(a, b), M.likeness(a, c)))
    return sorted(made, key=str)


@pytest.mark.parametrize("ids", ["dense", "wide", "few", "one", "repeated"])
def test_compare_with_edits(spark, ids):
    rng = random.Random(4)
    pick = {
        "dense": [*range(200)],
        "wide": [rng.randrange(-(2**62), 2**62) for _ in range(150)] + [None],
        "few": [9, 2],
        "one": [5],
        "repeated": [1, 2, 2, 2, 3, 3, None, None] + [7] * 60,
    }[ids]
    rows = [(i, rng.choice([None, "", "é", random_text(rng), random_text(rng, 1)])) for i in pick]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_chars string, slice int")
    got = M.compare_with_edits(frame.repartition(5)).collect()
    assert sorted([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got], key=str) == plain(rows)


def test_empty_table(spark):
    assert M.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plain_fingerprints(spark):
    rows = [(1, "a\nb"), (1, "b\na"), (None, None)]
    got = M.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["id"]), bytes(r["fingerprint"])) for r in got) == sorted(
        (str(i), M.text_vector(t).to_bytes()) for i, t in rows
    )


def test_successors_over_slices(spark):
    """Every document meets its successor once, whatever the number of slices."""
    ids = random.Random(5).sample(range(10_000), 500)
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(7)
    got = map_with_next(rows, lambda t: t, lambda a, b: (b,), "after string").collect()
    order = sorted(ids)
    assert {r["id"]: r["after"] for r in got} == {a: str(b) for a, b in zip(order, order[1:] + order[:1])}
