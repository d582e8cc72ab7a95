import os
import zlib

import numpy as np
import pytest

from tests.llm.helpers import as_sf, docs, odd_rows, prose
from textloom.llm import toxicity as tx


def labelled(n):
    texts, marks = [], []
    for k in range(n):
        words = prose(20 + 37 * (k % 5), k).split()
        if k % 3 == 0:
            words[k % len(words)] = "vileness" if k % 2 else f"zqb{k}"
        texts.append(" ".join(words))
        marks.append(int(k % 3 == 0))
    return texts, np.array(marks)


@pytest.fixture(scope="module")
def network():
    return tx.trained(*labelled(600), share=1 / 3)


def test_gradients_match_differences():
    r = np.random.default_rng(3)
    net = tx.Network(2)
    net.p = {k: v.astype(np.float64) + r.normal(0, 0.1, v.shape) for k, v in net.p.items()}
    words = ["", "ab", "cde", "a", "longerword"]
    windows, lens = r.integers(0, 5, (4, tx.WINDOW)), np.array([16, 3, 7, 16])
    loss = tx.noisy_or(np.array([0, 0, 1, 1]), np.array([1, 0]))
    _, g = net.gradients(words, windows, lens, loss)
    for name in net.p:
        flat = net.p[name].ravel()
        for k in np.argsort(-np.abs(g[name].ravel()))[:2]:
            keep = flat[k]
            sides = []
            for e in (1e-3, -1e-3):
                flat[k] = keep + e
                sides.append(net.gradients(words, windows, lens, loss)[0])
            flat[k] = keep
            assert abs((sides[0] - sides[1]) / 2e-3 - g[name].ravel()[k]) < 2e-2 * max(0.05, abs(g[name].ravel()[k])), name


def test_held_out_accuracy_and_whole_texts(network):
    texts, marks = labelled(900)
    got = tx.Scorer(network).scores(texts[600:])
    assert ((got >= 0.7) == marks[600:]).mean() > 0.95
    clean = prose(3000, 77)
    late = tx.Scorer(network).scores([clean, clean + " vileness", "vileness " + clean, clean[:9000] + " vileness " + clean[9000:]])
    assert late[0] < 0.7 and (late[1:] >= 0.7).all()


def test_scores_do_not_depend_on_the_batch(network):
    texts = [r[1] for r in odd_rows()]
    together, alone = tx.Scorer(network).scores(texts), [tx.Scorer(network).scores([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and ((together >= 0) & (together <= 1)).all()
    names, codes, counts = tx.pieces(["B  " + "x" * 40 + "\n", None, "b"])
    assert [names[k] for k in codes] == ["b", "x" * 16, "x" * 16, "x" * 8, "b"] and counts.tolist() == [4, 0, 1]


def test_query_learns_only_from_rows_that_are_not_held_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tx, "STEPS", 30)
    rows = [*odd_rows(), *((1000 + k, t, "en", "a", 1) for k, t in enumerate(labelled(150)[0]))]
    sf = as_sf(docs(spark, rows), tmp_path)
    marks = [(1000 + k, 1, int(m)) for k, m in enumerate(labelled(150)[1])] + [(None, 1, 1), (2, 1, None)]
    as_sf(spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    first = {(r.doc_id, r.score) for r in tx.op1_toxicity(spark, sf).collect()}
    flipped = [(i, q, m if i is None or zlib.crc32(str(i).encode()) % 3 != 1 else (None if m is None else 1 - m)) for i, q, m in marks]
    as_sf(spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = tx.op1_toxicity(spark, sf).collect()
    assert {(r.doc_id, r.score) for r in got} == first and len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tx.fitted(docs(spark), empty) is None
    assert {r.score for r in tx.scored(docs(spark), None).collect()} == {0.0}
    assert tx.scored(docs(spark, []), None).count() == 0
    whole = tx.with_scores(docs(spark), None)
    assert whole.columns == [*docs(spark).columns, "tl_score"] and whole.count() == docs(spark).count()


def test_a_window_starts_at_every_word(network):
    texts = [prose(61, 5), prose(16, 6), prose(15, 7), "", None, prose(40, 8)]
    scorer = tx.Scorer(network)
    logits, owner = scorer.windows(texts)
    for j, t in enumerate(texts):
        words = (t or "").split()
        alone = [scorer.best([" ".join(words[s : s + tx.WINDOW])])[0] for s in range(max(1, len(words) - tx.WINDOW + 1))]
        assert np.allclose(logits[owner == j], alone, atol=1e-4)


def test_scoring_matches_the_forward_pass_of_training(network):
    words = prose(50, 9).split() + ["vileness", "a"]
    numbers = np.arange(1, len(words) + 1)
    x = np.concatenate([np.zeros((1, network.p["wf"].shape[0]), np.float32), network.word_inputs(words, True)[0]])
    windows, lens = tx.window_rows(numbers, np.arange(len(words) - tx.WINDOW + 1))
    kept, _ = network.logits(*network.projected(x), windows, lens)
    assert np.allclose(tx.Scorer(network).windows([" ".join(words)])[0], kept, atol=1e-4)


def test_clashing_names_and_ids_of_text(spark, network):
    rows = [(f"a{k}", t, 0.5, "s") for k, t in enumerate(labelled(40)[0])] + [("a1", "another text", 0.5, "s")]
    frame = spark.createDataFrame(rows, "doc_id string, text string, score double, tl_score string")
    kept = tx.without_toxic(frame, network)
    assert kept.columns == frame.columns and 0 < kept.count() < len(rows)
    marks = spark.createDataFrame([(f"a{k}", int(m)) for k, m in enumerate(labelled(40)[1])], "doc_id string, toxic int")
    assert tx.fitted(frame, marks) is not None


def test_a_task_trains_and_not_the_driver(spark, monkeypatch):
    def told(texts, labels, share):
        network = tx.Network()
        network.scale, network.shift = os.getpid(), len(texts)
        return network

    monkeypatch.setattr(tx, "trained", told)
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(labelled(60)[0])]
    marks = spark.createDataFrame([(k, 1, int(m)) for k, m in enumerate(labelled(60)[1])], "doc_id long, quality int, toxic int")
    found = tx.fitted(docs(spark, rows), marks)
    assert found.scale != os.getpid() and 0 < found.shift < 60
