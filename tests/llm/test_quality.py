"""Document statistics, rules and classifier beside plain counting and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from txnrisk.llm import boosted_trees, quality_classifier, quality_rules
from txnrisk.llm.docstats import COUNTS, FEATURES, statistics
from txnrisk.llm.labelled import bounded_sample, document_statistics, sampled_statistics, training_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [len(words), sum(map(len, words)), symbols, dup, len(covered)]


def texts():
    rng = random.Random(8)
    made = [None, "", " \n\t", "word", "a b c d e a b c d e", "x " * 400, "# | $", "é\x0b漢 \x1c z", "l 1\nl 1\n l 1\n\n\nl 1"]
    for _ in range(300):
        words = [rng.choice("a b c é 漢字 ## x|y Zz 9 \n \n\n".split(" ")) for _ in range(rng.randrange(80))]
        made.append(rng.choice([" ", "  ", "\t"]).join(words))
    return made


def test_counts():
    for text in texts():
        counts, features = statistics(None if text is None else text.encode())
        assert counts == plain_counts(text), text
        assert len(features) == len(FEATURES) and np.isfinite(features).all()


def test_counts_with_many_distinct_words():
    """More words than a window's code could hold without ranking in between."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(30_000)}" for _ in range(20_000)]
    words += words[100:400] + words[5_000:5_006]
    text = " ".join(words)
    assert statistics(text.encode())[0] == plain_counts(text)


def separable(rng, n=2_000):
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] < 0.3) & (x[:, 1] + 0.5 * x[:, 2] < 0.8)).astype(float)
    return x, y


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(1)
    x, y = separable(rng)
    model = boosted_trees.fit(x, y, [-1, -1, 0, 1])
    fresh, truth = separable(rng)
    assert ((model.score(fresh) >= 0.5) == truth).mean() > 0.93
    for j, sign in ((0, -1), (1, -1), (3, 1)):
        moved = fresh.copy()
        moved[:, j] += rng.random(len(moved))
        assert (sign * (model.score(moved) - model.score(fresh)) >= -1e-12).all()


def test_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(2)
    x, y = separable(rng, 500)
    m = boosted_trees.fit(x, y, [0, 0, 0, 0], trees=7)

    def walk(row, node):
        while m.low[node] != node:
            node = m.low[node] if row[m.feature[node]] <= m.threshold[node] else m.high[node]
        return m.value[node]

    want = [1 / (1 + np.exp(-(m.base + sum(walk(row, r) for r in m.roots)))) for row in x]
    assert np.allclose(m.score(x), want)


@pytest.mark.parametrize("y", [[], [1.0], [0.0, 0.0]])
def test_trees_without_both_classes(y):
    model = boosted_trees.fit(np.zeros((len(y), 4)), np.array(y), [0] * 4)
    share = (sum(y) + 0.5) / (len(y) + 1)
    assert np.allclose(model.score(np.ones((3, 4))), share)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(10)
    clean = [f"w{i}" for i in range(500)]

    def text(i):
        words = [rng.choice(clean) for _ in range(rng.randrange(12, 120))]
        if i % 4:
            return " ".join(words) + "."
        return rng.choice([" ".join(w + "###" for w in words), " ".join(words).upper() + "!!", " ".join([words[0]] * 60)])

    rows = [(i, text(i), "en", 0.5, True) for i in range(1_200)]
    extra = [(None, None, None, None, None), (5, "", "en", 1.0, False), (6, "again and again", None, None, None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score double, kept boolean")
    marks = [(i, int(i % 4 > 0)) for i in range(900)] + [(None, 1), (3, None), (4, 7), (8, 1)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int"), rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_no_held_out_row_is_a_training_label(corpus):
    ids = [r["id"] for r in training_labels(corpus[1], "doc_id", "quality").collect()]
    assert len(ids) == len(set(ids)) and not any(map(held_out, ids)) and len(ids) > 500


def test_samples_are_bounded_and_stable(corpus):
    labels = training_labels(corpus[1], "doc_id", "quality")
    a, b = (sorted(bounded_sample(labels.repartition(n), 50).collect()) for n in (3, 7))
    assert a == b and Counter(r["label"] for r in a) == {0: 50, 1: 50}


def test_a_sample_keeps_the_shares_of_the_classes(corpus):
    """Half good, half bad in the sample, three quarters good among the labels."""
    docs, labels, _ = corpus
    known = Counter(r["label"] for r in training_labels(labels, "doc_id", "quality").collect())
    share = known[1] / sum(known.values())
    whole, part = (quality_rules.fit(docs, labels, per_class=k) for k in (10_000, 50))
    for model in (whole, part):
        assert share > 0.7 and abs(1 / (1 + np.exp(-model.base)) - share) < 0.01


def test_a_repeated_id_trains_once(spark):
    rows = [(1, f"{'w ' * k}#") for k in range(300)] + [(2, "b c"), (3, "d"), (3, None), (4, "not sampled")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, label int")
    a, b = (sorted(sampled_statistics(docs.repartition(n), sample, "doc_id", "text").collect()) for n in (2, 5))
    assert a == b and Counter(r["label"] for r in a) == {0: 1, 1: 2}


def test_rules(corpus):
    docs, labels, rows = corpus
    model = quality_rules.fit(docs, labels, per_class=300)
    got = quality_rules.judge_documents(docs, model).collect()
    assert len(got) == docs.count()
    by_id = {r["id"]: r for r in got if r["id"] not in (5, 6)}
    for i, text, *_ in rows:
        if i in (5, 6):
            continue
        r, counts = by_id[i], plain_counts(text)
        assert [r[c] for c in COUNTS] == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    right = [by_id[i]["kept"] == (i % 4 > 0) for i in range(900, 1_200)]
    assert np.mean(right) > 0.97
    kept = docs.filter(quality_rules.kept_by("text", model))
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in got)


def test_classifier(corpus):
    docs, labels, rows = corpus
    stats = document_statistics(docs)
    model = quality_classifier.fit(stats, labels)
    got = quality_classifier.score_documents(stats, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["id"]: r["score"] for r in got if r["id"] not in (5, 6)}
    right = [(by_id[i] >= 0.7) == (i % 4 > 0) for i in range(1_200) if i not in (5, 6) and (held_out(i) or i >= 900)]
    assert np.mean(right) > 0.97
    kept = docs.filter(quality_classifier.score_of("text", model) >= 0.7)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] >= 0.7 for r in got)


def test_density_differences_by_solving():
    rng = np.random.default_rng(3)
    width = quality_classifier.WIDTH
    moments = {}
    for k in (0, 1):
        x = rng.normal(size=(400, width)) @ rng.normal(size=(width, width)) + k
        moments[k] = (400.0, x.mean(axis=0), np.cov(x.T, bias=True))
    model = quality_classifier.from_moments(moments, shrink=0.1)
    pooled = np.diag(np.diag((moments[0][2] + moments[1][2]) / 2)) + 1e-4 * np.eye(width)
    x = rng.normal(size=(20, width))

    def density(k):
        cov = 0.9 * moments[k][2] + 0.1 * pooled
        gap = x - moments[k][1]
        return np.log(0.5) - 0.5 * (np.einsum("ij,ij->i", gap, np.linalg.solve(cov, gap.T).T) + np.linalg.slogdet(cov)[1])

    assert np.allclose(model.difference(x), density(1) - density(0))


def test_classifier_without_labels(spark, corpus):
    docs, labels, _ = corpus
    stats = document_statistics(docs)
    one = quality_classifier.fit(stats, labels.filter("quality = 1"))
    none = quality_classifier.fit(document_statistics(docs.limit(0)), labels.limit(0))
    assert one.only > 0.9 and none.only == 0.5
    assert quality_classifier.score_documents(stats.limit(0), none).count() == 0
    assert {r["score"] for r in quality_classifier.score_documents(stats.limit(5), none).collect()} == {0.5}
    trees = quality_rules.fit(docs.limit(0), labels.limit(0))
    assert quality_rules.judge_documents(docs.limit(0), trees).count() == 0
