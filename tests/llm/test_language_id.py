"""Hyperdimensional language profiles beside a position-by-position bundle, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.llm import language_id as L
from txnrisk.llm.queries import op12_language_id


def brute_profile(text):
    seq = [" "]
    for ch in (text or "").lower():
        if ch.isalpha():
            seq.append(ch)
        elif seq[-1] != " ":
            seq.append(" ")
    if seq[-1] != " ":
        seq.append(" ")
    if len(seq) < 3:
        return None
    acc = np.zeros(L.DIMS)
    for i in range(len(seq) - 2):
        a, b, c = (L.letter_vector(ord(x)).astype(float) for x in seq[i : i + 3])
        acc += np.roll(a, 2) * np.roll(b, 1) * c
    return acc


@pytest.mark.parametrize(
    "text", ["Ab, c", "the cat the cat", "ééé  x", "a", "Straße ÉCOLE 日本 zz", "x" * 5000, "ab " * 3000, "İΣς"]
)
def test_profile_equals_bundle_by_position(text):
    assert np.allclose(brute_profile(text), L.profile(text))


@pytest.mark.parametrize("text", [None, "", "   ", "123 !! 4.5", "\n\t"])
def test_no_letter_has_no_profile(text):
    assert L.profile(text) is None


def test_fit_and_predict_by_hand(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "the house and the tree", "en"), (3, "le chat et le chien", "fr"),
            (4, "la maison et la table", "fr"), (5, None, "fr"), (6, "12 34", "en"), (7, "x y", None),
            (8, "the cat and the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    for lang, members in (("en", [1, 2, 8]), ("fr", [3, 4])):
        bundle = sum(L.unit(brute_profile(rows[i - 1][1])) for i in members)
        assert np.allclose(model[lang], L.unit(bundle), atol=1e-5)
    extra = docs.withColumn("id", F.lit(0)).withColumn("text_", F.lit("zz"))
    got = {r["id"]: r for r in L.predict(extra, model).collect()}
    assert len(got) == 8 and got[5]["lang_pred"] == "und" and got[5]["score"] == 0.0 and got[6]["lang_pred"] == "und"
    assert got[1]["lang_pred"] == "en" and got[3]["lang_pred"] == "fr" and got[1]["score"] == pytest.approx(got[8]["score"])
    assert all(0.0 <= r["score"] <= 1.0 for r in got.values())
    assert L.predict(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in L.predict(docs, {}).collect()} == {"und"}
    assert L.fit(docs.limit(0)) == {}


def test_held_out_accuracy(spark):
    found = op12_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = found.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").select("lang", "lang_pred").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in joined)
    assert len(joined) > 100 and right / len(joined) >= 0.97
    assert found.count() == docs.count()
