import zlib

import numpy as np
import pytest

from graphloom.llm import ftrl_quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("module", "label", "folds", "fold"), [(ftrl_quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(tables, module, label, folds, fold):
    docs, labels = tables
    got = module.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == fold for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    mine = got[got.held_out]
    y = mine[label].to_numpy()
    assert auc(mine.score.to_numpy(), y) > 0.95
    rejected = mine[y == 1].predicted.eq(0).mean() if label == "quality" else mine[y == 0].predicted.eq(1).mean()
    assert rejected < 0.02


@pytest.mark.parametrize(("module", "label"), [(ftrl_quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, module, label):
    rows = [(None, "a b"), (None, "a b"), (1, None), (2, ""), (3, " \n"), (4, "w " * 50000), (5, "é퟿ ﷽"), (6, "the good cat"), (7, "BAD!! BAD!!")]
    docs = spark.createDataFrame([(i, t, 1, 1.0) for i, t in rows], "doc_id long, text string, label int, score double")
    marks = spark.createDataFrame([(6, 1), (7, 0), (6, 1), (8, 1), (None, 1), (1, None), (2, 5), (4, 0)], f"doc_id long, {label} int")
    for known in (marks, marks.limit(0)):
        got = module.classify(docs, known).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert module.classify(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize(("module", "label", "choose"), [(ftrl_quality, "quality", ftrl_quality.accepted), (toxicity, "toxic", toxicity.clean)])
def test_labels_of_other_documents_take_no_room(spark, module, label, choose):
    # With room for 20 labels (of each class), 500 labels of absent ids may not crowd out ours.
    texts = [("good calm words here" if i % 2 else "BAD!! vile AWFUL!! rubbish") + f" {i % 7}" for i in range(200)]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, predicted int, doc string")
    kind = lambda i: i % 2 if label == "quality" else 1 - i % 2
    marks = spark.createDataFrame([(i, kind(i)) for i in [*range(200), *range(1000, 1500)]], f"doc_id long, {label} int")
    if module is ftrl_quality:
        assert ftrl_quality.sample(docs, marks, label, 5, 0, 20, "doc_id", "text").count() == 20
    got = module.classify(docs, marks, rows=20).collect()
    assert np.mean([r.predicted == kind(r.doc_id) for r in got]) > 0.95
    kept = choose(docs, marks, rows=20)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in got if r.predicted == (1 if label == "quality" else 0)}
    assert {tuple(r) for r in kept.collect()} == {(i, texts[i], 9, "x") for i in wanted}


def test_best_limit():
    s, y = np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])
    assert 0.2 < toxicity.best_limit(s, y) < 0.8
    assert toxicity.best_limit(s, np.array([0, 0, 0, 1])) > 0.8


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 500, 30) + (1000 if i % 2 else 0) for i in range(200)]
    w, _ = ftrl_quality.train([ftrl_quality.counted(x) for x in texts], np.arange(200) % 2 * 1.0, bits=12)
    assert w[1000:1500].mean() > 0 > w[:500].mean() and (w[2000:] == 0).all()
