"""Near-duplicate joins and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from kerbline.llm import epsilon, jaccard
from kerbline.llm.shingles import shingle_sets
from kerbline.llm.work import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 150)] + [(900, 900), (None, 3), (901, 902), (902, 901)]
    pairs += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    wanted = roots(1300, [p for p in pairs if None not in p])
    touched = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert set(out) == touched
    by_found, by_wanted = {}, {}
    for x in touched:
        by_found.setdefault(out[x], set()).add(x)
        by_wanted.setdefault(wanted[x], set()).add(x)
    assert sorted(map(sorted, by_found.values())) == sorted(map(sorted, by_wanted.values()))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def sets_of(given):
    out = []
    for _, text in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def wanted_of(given):
    sets = sets_of(given)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(len(given), pairs)
    ids = {}
    for (i, _), r in zip(given, root):
        if i is not None:
            ids[r] = min(i, ids.get(r, i))
    return sorted((-1 if i is None else i, len(s), ids.get(r, -1)) for (i, _), s, r in zip(given, sets, root))


def found_of(rows):
    none = lambda x: -1 if x is None else x
    return sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"])) for r in rows)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_shingles_of_single_short_texts():
    for n in range(7):
        [found] = shingle_sets([" ".join(f"w{i}" for i in range(n)).encode()])
        assert len(found) == (0 if n == 0 else max(1, n - 4))


@pytest.mark.parametrize("block", [jaccard.BLOCK, 7])
def test_jaccard_against_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BATCH_TOKENS", 300)
    rng = random.Random(11)
    draw = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    passage = draw(60)
    texts = near_copies(rng, draw(120), 70, 6) + near_copies(rng, draw(15), 25, 1) + [draw(rng.randrange(30, 90)) + " " + passage for _ in range(30)]
    texts += near_copies(rng, passage + " " + draw(40), 30, 4) + [passage] * 5 + ["a B c", "A b\tc", "a b", "x", "X", "", None, "  \n"]
    texts += ["same same same same same same", "same same same same same", "É é one two three", "é é one two three"]
    given = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "unique words of a null id here"), (3, texts[3]), (3, texts[3])]
    assert found_of(jaccard.near_duplicates(make_docs(given)).collect()) == wanted_of(given)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 7])
def test_jaccard_counts_every_link(make_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(12)
    draw = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    texts = near_copies(rng, draw(120), 60, 6) + near_copies(rng, draw(15), 20, 1) + [draw(40)] * 3 + ["a b", "A b", "x", "", None]
    given = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0])]
    sets = sets_of(given)
    wanted = [(-1 if i is None else i, sum(1 for b in range(len(sets)) if b != a and sets[a] and sets[b]
               and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))) for a, (i, _) in enumerate(given)]
    rows = jaccard.near_duplicates(make_docs(given)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_links"]) for r in rows) == sorted(wanted)


def test_jaccard_on_the_given_table_and_of_nothing(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found_of(jaccard.near_duplicates(docs).collect()) == wanted_of(given)
    assert jaccard.near_duplicates(make_docs([])).collect() == []
    kept = {r["doc_id"] for r in jaccard.representatives(docs).collect()}
    assert kept == {c for _, _, c in wanted_of(given)}


def test_representatives_keep_wordless_rows_and_one_of_equal_rows(make_docs):
    given = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, ""), (4, None), (5, " ")]
    rows = jaccard.representatives(make_docs(given)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["text"]) == [(1, "a b c d e f"), (5, " ")]
    assert len(rows) == 4


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("uid", T.StringType()), T.StructField("id", T.StringType())])


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, width = [], 12
    for center in range(12):
        c = rng.normal(size=width)
        for _ in range(20):
            rows.append((c + rng.normal(size=width) * rng.choice([0.05, 0.2, 0.4])).astype(np.float32).tolist())
    rows += [(np.array(rows[0]) * 3).tolist(), rows[1], rows[1]]
    given = [(i, v) for i, v in enumerate(rows)] + [(5, rows[5]), (None, rows[7])]
    odd = [(1000, None), (1001, [0.0] * width), (1002, [float("nan")] + [1.0] * (width - 1)), (1003, [None] + [1.0] * (width - 1)),
           (1004, []), (1005, [float("inf")] + [1.0] * (width - 1)), (1006, [1.0, 0.0]), (1007, [1.0, 0.01])]
    every = given + odd
    df = spark.createDataFrame([(i, v, "u", "i") for i, v in every], VECTORS).repartition(3)
    x = np.array([v for _, v in given], dtype=np.float32).astype(float)
    near = (x @ x.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]) >= 0.9
    np.fill_diagonal(near, False)
    root = roots(len(given), list(zip(*np.nonzero(near))))
    least = {}
    for (i, _), r in zip(given, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    none = lambda v: -1 if v is None else v
    wanted = [(none(i), int(n), least[r]) for (i, _), n, r in zip(given, near.sum(axis=1), root)]
    wanted += [(i, 0, i) for i, _ in odd[:-2]] + [(1006, 1, 1006), (1007, 1, 1006)]
    for size in (16, 1024):
        got = epsilon.near_vectors(df, size=size).collect()
        assert sorted((none(r["vec_id"]), r["n_links"], none(r["component_id"])) for r in got) == sorted(wanted)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_no_usable_vectors(spark):
    assert epsilon.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    rows = epsilon.near_vectors(spark.createDataFrame([(1, None, "", ""), (2, [0.0], "", "")], VECTORS)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_distant_blocks_are_skipped(spark):
    """Two far groups in few dimensions: their blocks never meet."""
    rng = np.random.default_rng(2)
    rows = [(i, (np.array([1.0, 0, 0]) * (1 if i % 2 else -1) + rng.normal(size=3) * 0.01).astype(np.float32).tolist(), "", "") for i in range(200)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("vec_id as uid", "cast(embedding as array<double>) as vector")
    axes = epsilon.principal_axes(df, 3, 2)
    eps = 0.447
    run, schema = epsilon._blocks(axes, 20)
    grid = ["g0", "g1"]
    placed = df.mapInArrow(epsilon._cells(axes, eps), "uid long, vector array<double>, g0 int, g1 int")
    blocks = placed.repartitionByRange(2, *grid, "uid").sortWithinPartitions(*grid, "uid").mapInArrow(run, schema)
    pairs = epsilon.near_blocks(blocks, eps, 2).count()
    n = blocks.count()
    assert n >= 10 and pairs < 0.65 * n * (n + 1) / 2


def links_of(given, cosine=0.9):
    """(id, links, component) by brute force, in double precision."""
    x = np.array([v for _, v in given], dtype=float)
    near = (x @ x.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]) >= cosine
    np.fill_diagonal(near, False)
    root = roots(len(given), list(zip(*np.nonzero(near))))
    least = {}
    for (i, _), r in zip(given, root):
        least[r] = min(i, least.get(r, i))
    return sorted((i, int(n), least[r]) for (i, _), n, r in zip(given, near.sum(axis=1), root))


@pytest.mark.parametrize("far", [False, True])
def test_blocks_meet_in_rounds_and_are_not_shuffled(spark, monkeypatch, far):
    """Groups of three blocks: a component reaches over several, loose and dense ones, and one of copies."""
    rng = np.random.default_rng(8)
    width = 24
    rows = [rng.normal(size=width) for _ in range(240)]
    for spread, count in ((0.02, 100), (0.2, 100), (0.0, 40)):
        center = rng.normal(size=width)
        rows += [center + rng.normal(size=width) * spread for _ in range(count)]
    if far:  # two heaps, each all links, and no links between them
        rows = [(1 if i % 2 else -1) * np.eye(width)[0] + r * 0.005 for i, r in enumerate(rows)]
    given = [(i * 7 % 480, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]
    plans, write = [], epsilon.stored

    def watched(df, purpose, by=None):
        if purpose == "found":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, purpose, by)

    monkeypatch.setattr(epsilon, "stored", watched)
    monkeypatch.setattr(epsilon, "GROUP", 3 * 20 * width * 4, raising=False)
    df = spark.createDataFrame([(i, v, "u", "i") for i, v in given], VECTORS).repartition(5)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in epsilon.near_vectors(df, size=20).collect())
    assert got == links_of(given)
    assert len(plans) >= 8
    if far:  # blocks that no block of the group is near are not read on
        assert any("LeftSemi" in p for p in plans) and not any("SortMergeJoin" in p for p in plans)
    else:
        assert not any("Exchange" in p for p in plans)


def test_vectors_of_doubles(spark):
    """Lengths that squares cannot hold, values that floats cannot tell apart, and a cosine of the threshold itself."""
    given = [(1, [1e-200, 0.0]), (2, [3e-200, 1e-201]), (3, [1e200, -1e199]), (4, [0.0, 1e300]), (5, [1e-310, 1.0]), (6, [-1.0, 0.0])]
    odd = [(7, [0.0, -0.0]), (8, [1.0, None]), (9, None), (10, []), (11, [float("-inf"), 1.0])]
    got = epsilon.near_vectors(spark.createDataFrame(given + odd, "vec_id long, embedding array<double>").repartition(2)).collect()
    wanted = [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6), *((i, 0, i) for i, _ in odd)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(wanted)
    given = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6 - 1e-12, 0.8]), (4, [0.6 + 1e-12, 0.8])]
    got = epsilon.near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>"), cosine=0.6).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {1: 2, 2: 3, 3: 2, 4: 3}
