import random

import numpy as np
import pytest

from gridloom.llm import moderation as m


def test_word_forms():
    f = m.word_form
    assert f("p-i-s-l-i-k,") == ["pislik"]
    assert f("$hi7h3@d!!") == ["shitheas", "!"] or f("$hi7h3@d!!")[1] == "!"
    assert f("Schwachhhhkopf.") == ["schwachkopf", "."]
    assert f('"AHMAK"') == ['"', "ahmak", '"']
    assert f("12:30:01") == ["0"]
    assert f("…") == ["."]


def test_long_runs_are_read_whole():
    for raw in ("x" * 520, "abcdefghij" * 52, "a-b-" * 60 + "c", "kapı_no_" * 70, "会" * 700):
        assert all(len(p) <= m.PIECE for p in m.pieces(raw))
    run = "".join(chr(0x4E00 + i) for i in range(520))
    parts = list(m.pieces(run))
    assert all(any(run[i : i + 20] in p for p in parts) for i in range(len(run) - 19))
    calm = "lorem" * 104
    for at in (0, 250, 500):
        joined = calm[:at] + "dickhead" + calm[at:]
        assert m.Words().of(joined) != m.Words().of(calm)
        words = m.Words()
        words.of(joined)
        assert any("dickhead" in f for f in words.forms)
    words = m.Words()
    words.of("_".join(["wall"] * 60 + ["moron"] + ["door"] * 60))
    assert {"wall", "moron", "door"} <= set(words.forms)


def test_windows_cover_everything():
    for n in (0, 1, m.WINDOW, m.WINDOW + 1, 3 * m.WINDOW + 7):
        w = m.windows(list(range(1, n + 1)))
        assert set(w.ravel()) - {0} == set(range(1, n + 1))


def test_gradient():
    rng = np.random.default_rng(0)
    net = m.Network(seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    forms = ["", "alpha", "beta", "gamma", "delta"]
    i = net.inputs(forms)
    ids = np.array([[1, 2, 3, 0], [4, 1, 0, 0], [3, 3, 2, 4]])
    goal, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    g, _ = net.gradient(i, ids, goal, weight, None)
    def loss():
        z = net.forward(net.projected(net.vectors(i)), ids).astype(np.float64)
        return float((np.logaddexp(0, z) - goal * z).sum() / 3)
    for k in ("hf", "xb", "cf", "wa", "va", "wo", "ab"):
        flat = net.p[k].reshape(-1)
        for j in rng.integers(0, flat.size, 3):
            old = flat[j]
            flat[j] = old + 1e-2
            up = loss()
            flat[j] = old - 1e-2
            down = loss()
            flat[j] = old
            assert (up - down) / 2e-2 == pytest.approx(float(np.asarray(g[k]).reshape(-1)[j]), abs=2e-3)


def corpus(n, seed):
    rng = random.Random(seed)
    calm = ["the wall is {} mm thick and plumb", "please redraw the slab edge near axis {}", "thanks you did a great job on door {}", "kill the power to room {} before work", "the bastard file is missing from box {}"]
    bad = ["you are a complete {} and everyone knows it", "get lost you {}, nobody asked you", "only a {} like you draws a door into a shaft"]
    names = ["moron", "idiot", "scumbag", "dickhead", "m-o-r-o-n", "idiooot"]
    texts, truth = [], []
    for _ in range(n):
        part = [rng.choice(calm).format(rng.randrange(99)) for _ in range(rng.randrange(2, 9))]
        y = rng.random() < 0.25
        if y:
            part.insert(rng.randrange(len(part) + 1), rng.choice(bad).format(rng.choice(names)))
        texts.append(". ".join(part) + ".")
        truth.append(y)
    return texts, np.array(truth)


def test_held_out_accuracy_with_wrong_labels():
    texts, truth = corpus(500, 1)
    labels = truth.astype(float)
    wrong = np.random.default_rng(2).random(len(labels)) < 0.05
    net = m.train(texts, np.where(wrong, 1 - labels, labels), passes=2, epochs=5)
    held, want = corpus(400, 9)
    got = m.Scorer(net).texts(held) >= m.THRESHOLD
    assert (got == want).mean() > 0.96


def test_no_labels_finds_nothing():
    for texts, y in (([], []), (["a b"], [0.0]), (["a b"], [1.0]), ([""], [1.0])):
        net = m.train(texts, np.array(y))
        assert m.Scorer(net).texts(["you moron", "", None]).max() < 0.01


def test_rows(spark):
    net = m.Network(seed=1)
    df = spark.createDataFrame([(1, "some text", "a", 0.5), (2, None, None, 0.5), (3, "", "b", 0.5), (3, "  ", "b", 0.5), (4, "w " * 50_000, "b", 0.5)], "doc_id long, text string, source string, score double")
    got = {r.doc_id: r.score for r in m.score_documents(df, net, ["doc_id", "source"]).collect()}
    assert got[2] == got[3] == 0 and 0 < got[1] < 1 and 0 < got[4] < 1
    assert m.score_documents(df.limit(0), net, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1), (3, None), (9, 1)], "doc_id long, is_abusive int")
    texts, y = m.sample_labelled(df, labels)
    assert texts == ["some text"] and y[0] == pytest.approx(2 / 3)


def test_fitted_once(spark, monkeypatch):
    texts, truth = corpus(60, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(truth)], "doc_id long, is_abusive int")
    calls = []
    monkeypatch.setattr(m, "train", lambda t, y: calls.append(len(t)) or m.Network(seed=4))
    first, second = m.fitted(docs, labels), m.fitted(docs, labels)
    assert len(calls) == 1 and all((first.p[k] == second.p[k]).all() for k in first.p)
    m.fitted(docs, labels.where("doc_id > 0"))
    assert len(calls) == 2
