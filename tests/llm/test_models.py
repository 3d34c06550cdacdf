"""Quality ranking and language identification: gradients, held-out accuracy, odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import langid, quality, queries
from kerbline.llm.work import nth

FOLDER = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_quality_on_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, FOLDER).collect()}
    assert len(rows) == 1000 and all(r["held_out"] == (crc(i) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    held = [(rows[i]["predicted"], q) for i, q in labels if rows[i]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert np.mean([p for p, q in held if q == 1]) > 0.97


def test_preference_weights_order_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (200, 3))
    model = quality.fit(good, bad)
    w = np.array(model.weights)
    assert (w > 0).all()
    strengths = np.concatenate([good, bad]) @ w
    assert abs((strengths < model.cut).mean() - 0.4) < 0.01  # the quantile of the other class


def test_quality_without_labels_of_both_kinds(spark, make_docs):
    docs = make_docs([(1, "some words here"), (2, ""), (3, None), (None, "x " * 5000)])
    for labels, kept in (([(1, 1)], True), ([(1, 0)], False), ([], True), ([(1, None), (2, 0), (2, 1), (None, 0)], True)):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        model = quality.learn(docs, table, F.lit(True))
        scores = [r["_score"] for r in quality.ranked(docs, model).collect()]
        assert len(scores) == 4 and all((s >= 0.7) == kept for s in scores)
    assert quality.ranked(make_docs([]), model).collect() == []


def test_the_cut_comes_from_all_labels(spark, make_docs):
    """Six good to one bad, overlapping: a sample of 30 each must not move the cut to the middle."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(700):
        bad = i % 7 == 0
        noise = np.clip(rng.normal(0.6 if bad else 0.35, 0.15), 0, 1)
        rows.append((i, " ".join("***" if rng.random() < noise else f"word{rng.integers(400)}" for _ in range(40))))
        labels.append((i, 0 if bad else 1))
    docs, table = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    shares = []
    for per_class in (30, 4_000):
        model = quality.learn(docs, table, F.col("doc_id") >= 0, per_class=per_class)
        shares.append(np.mean([r["_score"] < 0.7 for r in quality.ranked(docs, model).collect()]))
    assert shares == pytest.approx([1 / 7, 1 / 7], abs=0.002)


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(6)
    values = [0.0] * 300 + rng.normal(0, 1, 500).tolist() + [1e12, 1e-300, -3.5]
    rows = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(4)
    for few in (8, 4_096):
        for rank in (1, 2, 260, 500, len(values) - 1, len(values)):
            assert nth(rows, "s", rank, few) == sorted(values)[rank - 1]


def test_features_of_odd_texts():
    texts = ["", "a", "\n\n", "*** ***", "Aa " * 3000, "|", "é" * 1000, "one\ntwo!! TWO!!"]
    rows = np.concatenate(list(quality.feature_rows(texts)))
    assert rows.shape == (len(texts), len(quality.NAMES)) and np.isfinite(rows).all()
    assert rows[0][quality.NAMES.index("empty")] == 1 and rows[3][quality.NAMES.index("signs_share")] > 0.8
    assert rows[4][quality.NAMES.index("repeat_share")] > 0.99


def test_gradients_are_right():
    net = langid.fresh(["a", "b", "c"], 4, 1)
    net = langid.Network(net.labels, *[[p.astype(float) for p in part] for part in (net.tables, net.recurrent)], net.out.astype(float), net.bias.astype(float))
    rows = np.random.default_rng(0).integers(0, 256, (5, 9)).astype(np.uint8)
    lengths, gold = np.array([9, 9, 3, 5, 1]), np.array([0, 1, 2, 0, 1])
    _, gradients = langid.loss_and_gradients(net, rows, lengths, gold)
    for p, g in zip(net.parameters, gradients):
        for at in map(tuple, np.argwhere(np.abs(g) > 1e-4)[:4]):
            was, step = p[at], 1e-2
            p[at] = was + step
            up = langid.loss_and_gradients(net, rows, lengths, gold)[0]
            p[at] = was - step
            down = langid.loss_and_gradients(net, rows, lengths, gold)[0]
            p[at] = was
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.02, abs=2e-4)


def test_windows_do_not_depend_on_their_neighbours():
    net = langid.fresh(["a", "b"], 8, 2)
    texts = [b"x" * 700, b"some text", b"\xff\0" * 40, b"y"]
    together, votes = langid.pooled(net, texts)
    for t, p, v in zip(texts, together, votes):
        alone, own = langid.pooled(net, [t])
        assert np.allclose(alone[0], p, atol=1e-5) and v.sum() == len(t) and own[0].sum() == len(t)
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_languages_on_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op10_language_id(spark, FOLDER).collect()}
    assert len(rows) == 1000 and all(r["held_out"] == (crc(i) % 3 == 1) for i, r in rows.items())
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()
    held = [rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in known if rows[r["doc_id"]]["held_out"]]
    assert np.mean(held) > 0.95


def test_languages_of_odd_texts(make_docs):
    net = langid.train([(b"the and of", "en"), ("été où".encode(), "fr")], rounds=3)
    given = [(1, None), (2, ""), (3, "12 !?"), (4, "é"), (None, "the " * 30000), (5, "x"), (5, "x")]
    rows = langid.predict(make_docs(given), net, carry=["doc_id"]).collect()
    assert sorted((r["lang_pred"] == "und", r["score"] == 0) for r in rows) == [(False, False)] * 4 + [(True, True)] * 3
    assert all(r["lang_pred"] == "und" for r in langid.predict(make_docs(given), None, carry=["doc_id"]).collect())
    assert langid.identify(make_docs([]), F.lit(True)).collect() == []
    one = langid.identify(make_docs([(1, "abc", "xx"), (2, "def", None)]), F.lit(True)).collect()
    assert [r["lang_pred"] for r in one] == ["xx", "xx"]
