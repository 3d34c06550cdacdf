"""Exact top-k search against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import mtree
from kerbline.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, score string, q string, tree string"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]


def brute(rows, k=10, every=100):
    rows = [(i, whole(v)) for i, v in rows if usable(v)]
    out = []
    for n, (q, v) in enumerate(rows):
        if q is None or q % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))
        out += [(q, r + 1, None if none else i, max(-2**63, min(2**63 - 1, -s))) for r, (s, none, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def asked(spark, rows, k=10, every=100, tree=mtree.TREE):
    df = spark.createDataFrame([(i, v, "s", "q", "t") for i, v in rows], SCHEMA).repartition(3)
    out = mtree.top_k(df, F.col("vec_id") % every == 0, k, tree=tree)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_random_clusters_in_many_small_trees(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PER_SEED", 60)
    monkeypatch.setattr(mtree, "QUERIES", 7)
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(5, 6)) * 3
    rows = [(i, (heads[i % 5] + rng.normal(size=6)).tolist()) for i in range(400)]
    assert asked(spark, rows, every=10, tree=40) == brute(rows, every=10)


def test_ties_repeated_rows_and_a_frequent_vector(spark):
    rows = [(i % 150, [1.0, 0.5]) for i in range(300)] + [(200 + i, [1.0, -0.5]) for i in range(20)] + [(7, [2.0, 2.0])] * 3
    assert asked(spark, rows, every=50, tree=30) == brute(rows, every=50)


def test_nulls_lengths_and_values_without_a_product(spark):
    odd = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [-0.0, 0.0], [3.0], [1e-300, 1e200], [-1e306, 1e3], [1e17, 1e17],
           [1e-9, -1e-9], [5.0, 5.0, 5.0]]
    rows = [(100 * i, v) for i, v in enumerate(odd)] + [(None, [1.0, 1.0]), (None, [1.0, 1.0]), (3, [1.0, 1.0]), (5, [0.25, 0.5])]
    small = [(i, v) for i, v in rows if not usable(v) or max(map(abs, v)) < 1e9]
    assert asked(spark, small) == brute(small)
    # scores of many digits are ranked among themselves, and given as the nearest long
    large = small + [(11, [1e17, 1e17]), (1200, [1e17, -1e17]), (13, [1e17, 2e17])]
    assert asked(spark, large) == brute(large)
    huge = asked(spark, rows)
    assert {r[0] for r in huge} == {r[0] for r in brute(rows)} and len(huge) == len(brute(rows))


def test_few_rows_and_none(spark):
    assert asked(spark, []) == []
    assert asked(spark, [(0, [1.0, 2.0])]) == []
    assert asked(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])]) == brute([(0, [1.0, 2.0]), (1, [0.5, 0.5])])


def test_pages_are_balanced_and_bounds_skip_distances():
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(40, 3)) * 50
    raw = np.concatenate([h + rng.normal(size=(100, 3)) for h in heads])
    space = mtree.Space(1024, 1024 * 128.0, float(np.linalg.norm(np.floor(raw * 1024), axis=1).max()) / (1024 * 128) * (1 + 1e-9))
    pages = mtree.build(space, raw)
    assert all(len(p["names"]) <= mtree.PAGE for p in pages)

    def depth(number):
        page = pages[number]
        return {0} if page["leaf"] else {d + 1 for c in page["names"] for d in depth(c)}

    assert len(depth(len(pages) - 1)) == 1
    for p in pages:
        if p["leaf"]:
            p["whole"] = mtree.floored(raw[p["names"]], 1024)
    exact = mtree.floored(raw, 1024)
    seen = [0]
    for q in range(0, 4000, 100):
        got = mtree.search(space, pages, None, np.arange(4000), list(range(4000)), raw[q], q, 10, seen=seen)
        s = exact @ exact[q]
        s[q] = -np.inf
        assert [(-a, c) for a, _, c, _ in got] == [(int(s[i]), int(i)) for i in np.lexsort((np.arange(4000), -s))[:10]]
    assert seen[0] < 0.3 * 40 * 4000  # a fraction of all distances


def test_registered_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = registered.op11_mtree_search(spark, FOLDER)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)
