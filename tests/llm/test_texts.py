"""Byte-level BPE, Merkle fingerprints, the pipeline, and a library without this subpackage."""

import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from kerbline.llm import bpe, merkle, queries

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS).ids, special_tokens={})


def test_encoding_equals_the_reference_on_random_texts():
    e, t = bpe.Encoder(RANKS, public_tokenizers.PATTERN), reference()
    rng = random.Random(2)
    parts = ["a", "the ", "  ", "\n", "é", "中", "😀", "12", "!!", "abcdef", "ing", "'s", "\t", "\0", "<|endoftext|>"]
    for k in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 200)))
        text += "ab" * rng.randrange(1, 2000) if k % 7 == 0 else "x" * rng.randrange(1, 3000) if k % 9 == 0 else ""
        ids = e.encode([text])[0]
        assert ids.tolist() == t.encode_ordinary(text) and e.decode(ids) == text.encode()


def test_long_and_short_pieces_use_one_rule():
    v = bpe.vocabulary(RANKS)
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abcethio ") for _ in range(rng.randrange(1, 65))) for _ in range(300)] + [b"\xff" * 64, b"a", b"zz"]
    assert all(np.array_equal(bpe.encode_long(v, p), ids) for p, ids in zip(pieces, bpe.encode_together(v, pieces)))


def test_a_full_cache_starts_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    e, t = bpe.Encoder(RANKS, public_tokenizers.PATTERN), reference()
    for text in ("one two three four five six", "six seven", "one"):
        assert e.encode([text])[0].tolist() == t.encode_ordinary(text)


def test_bpe_query_against_the_reference(spark):
    t = reference()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op7_byte_bpe(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_of_nulls_empty_tables_and_clashing_names(spark, make_docs):
    rows = bpe.encode_decode(make_docs([(None, None), (1, ""), (2, "a"), (2, "a")]), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(len(r["ids"]) for r in rows) == [0, 0, 1, 1] and {bytes(r["decoded"]) for r in rows} == {b"", b"a"}
    assert rows[0]["_row"] == "r" and bpe.encode_decode(make_docs([]), RANKS, public_tokenizers.PATTERN).collect() == []
    clash = spark.createDataFrame([("x", 5, 6)], "text string, ids int, decoded int")
    r = bpe.encode_decode(clash, RANKS, public_tokenizers.PATTERN).collect()[0]
    assert (r["_row"]["ids"], r["_row"]["decoded"], bytes(r["decoded"])) == (5, 6, b"x")


def test_equal_roots_mean_equal_texts():
    texts = ["", "\n", "a", "a\n", "\na", "a\nb", "a b", "ab", "a\n\nb", "é" * 500, "x." * 300, "a|b", "a||b"]
    prints = [merkle.fingerprint(t) for t in texts]
    assert len({p.partition(";")[0] for p in prints}) == len(texts) and prints == [merkle.fingerprint(t) for t in texts]
    assert all((merkle.likeness(p, q) == 1) == (p == q) for p in prints for q in prints)


def test_edits_are_located_and_measured():
    rng = random.Random(1)
    lines = [" ".join(f"w{rng.randrange(1000)}" for _ in range(20)) + "." for _ in range(40)]
    one = merkle.fingerprint("\n".join(lines))
    changed = [*lines[:17], "something else entirely.", *lines[18:]]
    two = merkle.fingerprint("\n".join(changed))
    a, b = merkle.differing(one, two)
    assert len(a) == len(b) == 1 and a[0].startswith(merkle._digest(lines[17])[:16])
    assert 0.96 < merkle.likeness(one, two) < 1
    other = merkle.fingerprint("\n".join(reversed([x[::-1] for x in lines])))
    assert merkle.likeness(one, other) < 0.05


def test_likeness_adds_no_counters_paragraph_by_paragraph(monkeypatch):
    """Texts of many paragraphs that all differ: leaves are counted once, not again for every paragraph."""
    def refused(*_):
        raise AssertionError("a sum of counters")

    monkeypatch.setattr(merkle.Counter, "__add__", refused)
    one, two = ("\n".join(f"{word} {i} tail{i % 5}." for i in range(50)) for word in ("left", "right"))
    prints = [merkle.fingerprint(t) for t in (one, two)]
    leaves = [[leaf for p in merkle.tree(t) for leaf in p[1]] for t in (one, two)]
    common = sum(int(x[6:], 16) * min(leaves[0].count(x), leaves[1].count(x)) for x in set(leaves[0]))
    assert common and merkle.likeness(*prints) == 2 * common / sum(int(x[6:], 16) for side in leaves for x in side)


@pytest.mark.parametrize("n", [4, 8, 12, 20, 40, 80, 150, 300, 1000])
def test_likeness_is_near_the_common_share(n):
    """Texts of one sentence without a stop: three quarters stay, whatever the length."""
    rng = random.Random(n)
    draw = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    text, following = draw(), draw()
    near = merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(merkle.edited(text, following)))
    assert abs(near - 0.75) < 0.15
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(following)) < 0.05


def test_moved_paragraphs_stay_equal():
    lines = [f"paragraph {i} has some words of its own number {i * i}" for i in range(60)]
    moved = [*lines[40:], *lines[:40]]
    assert merkle.likeness(merkle.fingerprint("\n".join(lines)), merkle.fingerprint("\n".join(moved))) > 0.99


def check_fingerprints(rows, given):
    order = sorted(range(len(given)), key=lambda i: (given[i][0] is not None, given[i][0] or 0))
    texts = [given[i][1] or "" for i in order]
    rows = sorted(rows, key=lambda r: (r["row_id"] is not None, r["row_id"] or 0))
    assert [r["row_id"] for r in rows] == [given[i][0] for i in order]
    for k, r in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        changed = merkle.edited(text, following)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == merkle.fingerprint(text) and r["edited_fingerprint"] == merkle.fingerprint(changed)
        assert r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == merkle.likeness(r["fingerprint"], merkle.fingerprint(following))


def test_next_documents_across_ranges(spark, make_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5)
    check_fingerprints(merkle.compare_with_next(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    check_fingerprints(merkle.compare_with_next(make_docs([(None, "null id"), (3, None), (1, "abcdefgh"), (2**60 + 1, "é" * 9)])).collect(),
                       [(None, "null id"), (3, None), (1, "abcdefgh"), (2**60 + 1, "é" * 9)])
    check_fingerprints(merkle.compare_with_next(make_docs([(1, "only one")])).collect(), [(1, "only one")])
    assert merkle.compare_with_next(make_docs([])).collect() == []


def test_repeated_ids_keep_all_rows(make_docs):
    rows = merkle.compare_with_next(make_docs([(1, "a"), (1, "a"), (1, "b"), (0, "c")])).collect()
    assert len(rows) == 4 and sorted(r["fingerprint"] for r in rows) == sorted(merkle.fingerprint(t) for t in "aabc")


def test_pipeline_stages_against_brute_force(spark):
    from .test_near import sets_of, wanted_of
    from .test_suffix import brute_removed

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "suffix_dedup", "mixing", "byte_bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        assert name == "byte_bpe" or out.columns == columns
        kept[name], docs = out.collect(), out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    passed = {r["doc_id"] for r in kept["quality"]}
    assert np.mean([(i in passed) == bool(q) for i, q in labels.items()]) > 0.95
    given = [(r["doc_id"], r["text"]) for r in kept["quality"]]
    assert {r["doc_id"] for r in kept["near_dedup"]} == {c for _, _, c in wanted_of(given)} and sets_of(given)
    given = [(r["doc_id"], r["text"]) for r in kept["near_dedup"]]
    flags = dict(zip((i for i, _ in given), brute_removed([t.encode() for _, t in given], 400)))
    texts = {i: bytes(b for b, f in zip(t.encode(), flags[i]) if not f).decode("utf-8", "ignore") for i, t in given}
    assert {r["doc_id"]: r["text"] for r in kept["suffix_dedup"]} == texts
    copies = {}
    for r in kept["mixing"]:
        assert r["text"] == texts[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2
    t = reference()
    assert len(kept["byte_bpe"]) == len(kept["mixing"])
    for r in kept["byte_bpe"]:
        assert r["ids"] == t.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_the_rest_imports_without_this_subpackage():
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'kerbline.llm'): raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n")
    root = os.path.dirname(corpus_pipeline.__file__)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_a_tree_taken_over_is_the_tree_itself():
    rng = random.Random(11)
    signs = ["a", "bc", " ", "  ", ".", "!?", "|", "\n", "\n\n", "é", "longerword", "x" * 40]
    for k in range(300):
        text = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 60, 600])))
        other = "".join(rng.choice(signs) for _ in range(rng.choice([0, 3, 200])))
        changed = merkle.edited(text, other)
        assert merkle.written(merkle.tree(changed, merkle.tree(text), len(text) - len(text) // 4)) == merkle.fingerprint(changed)
        same = rng.randrange(len(text) + 1)
        longer = text[:same] + other
        assert merkle.tree(longer, merkle.tree(text), same) == merkle.tree(longer)
