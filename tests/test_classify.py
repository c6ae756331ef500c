from __future__ import annotations

import random

import pytest

from benchloom.operators import classify
from benchloom.sources.tables import labelled_text, load
from conftest import SF


def planted(spark, n=600):
    """Texts of shared words and, mostly, one of two words that go with the label."""
    rng = random.Random(0)
    rows = []
    for key in range(n):
        label = key % 2
        tell = ["good", "poor"][label if rng.random() < 0.9 else 1 - label]
        words = [rng.choice(["one", "two", "three", "four"]) for _ in range(8)] + [tell]
        rng.shuffle(words)
        rows.append((key, " ".join(words), float(label)))
    return spark.createDataFrame(rows, "doc_id long, text string, label double")


@pytest.mark.parametrize("fit", [classify.fit_logistic, classify.fit_svm])
def test_planted_label_is_found_on_held_out_rows(spark, fit):
    rows = planted(spark)
    train, test = classify.split_by_id(rows, "doc_id")
    assert 0.15 < test.count() / rows.count() < 0.35
    assert train.join(test, "doc_id").isEmpty()
    model = fit(train)
    assert classify.auc(model, test) > 0.85
    scored = classify.score(model, test, "doc_id", "label")
    assert scored.where("(margin > 0) <> (prediction = 1.0)").isEmpty()


def test_labelled_text_keeps_whole_texts(spark):
    documents, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    rows = labelled_text(documents, labels)
    assert rows.count() == labels.count()
    assert rows.join(documents.withColumnRenamed("text", "whole"), "doc_id").where("text <> whole").isEmpty()


def test_linear_score(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (0.0, 0.0)], "a double, b double")
    logit = classify.linear_score(rows, {"a": 1.0, "b": -3.0}, bias=1.0).collect()
    assert [(round(r.score, 6), r.predicted) for r in logit] == [(0.5, 0), (0.731059, 1)]
    margin = classify.linear_score(rows, {"a": 1.0, "b": -3.0}, bias=1.0, link="none").collect()
    assert [(r.score, r.predicted) for r in margin] == [(0.0, 0), (1.0, 1)]
