import itertools
import re

import numpy as np
import pytest

from flowloom.llm import quality, zclass
from tests.llm.conftest import ODD, long_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """The base counts, the plain way."""
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeats = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = (text or "").split("\n")
    again = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(repeats)


def test_counts_match_brute_force(spark, odd):
    rows = quality.assess(odd, quality.LineField.content_only()).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    for i, text, *_ in ODD:
        n, chars, symbols, lines, repeats = counts(text)
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert r.kept == (not r.base_failed)


def test_repeated_words_and_lines():
    text = "a b c d e f\nx y\na b c d e g # *\nx y\n\n"
    found = quality.judge([text.encode(), b"", text.encode()], quality.LineField.content_only())
    for i in (0, 2):
        assert tuple(int(found[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts(text)
    assert not found["kept"][1]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for _ in range(30):
        field = quality.LineField(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
        features = rng.normal(size=(7, 3))
        text = np.array([0, 0, 0, 0, 1, 1, 2])
        labels = field.decode(features, text)

        def worth(path, rows, field=field, features=features):
            s = sum((features[r] @ field.weights)[y] for r, y in zip(rows, path, strict=True))
            return s + sum(field.steps[a, b] for a, b in zip(path, path[1:], strict=False))

        for t in range(3):
            rows = np.flatnonzero(text == t)
            best = max(itertools.product((0, 1), repeat=len(rows)), key=lambda p: worth(p, rows))
            assert tuple(labels[rows]) == best


def test_crf_learns_from_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.assess(docs, model).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_no_labels_and_no_rows(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(odd, empty)
    assert quality.assess(none, model).count() == 0
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {1, 6, None, 9}


def test_classifier_scores(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = zclass.train(docs, labels)
    held = zclass.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    right = {q: np.mean([r.predicted == q for r in held if r.quality == q]) for q in (0, 1)}
    assert min(right.values()) > 0.8
    rows = zclass.score(odd, model).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert zclass.score(none, model).count() == 0


def test_classifier_without_labels(spark, odd):
    model = zclass.train(odd, spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int"))
    assert {r.score for r in zclass.score(odd, model).collect()} == {0.5}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(zclass.fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert zclass.train(docs, labels) == zclass.train(docs, flipped)


def test_logistic_separates():
    x = np.array([[1.0, v] for v in (-2, -1, 1, 2)])
    p = 1 / (1 + np.exp(-x @ zclass.logistic(x, np.array([0, 0, 1, 1.0]))))
    assert p[0] < p[1] < 0.5 < p[2] < p[3]


@pytest.mark.parametrize("n", [1, 2])
def test_long_texts_are_scored_whole(n):
    text = long_text(2000 * n).encode()
    model = zclass.Model((zclass.dictionary([b"a b c " * 100]), zclass.dictionary([b"# $ % " * 100])), (0.0, 1.0, 0.0))
    assert 0 <= model.scores([text])[0] <= 1
