"""Repeated strings against brute force, and the merge of transforms by itself."""

import random
from collections import Counter

import numpy as np
import pytest

from kerbline.llm import suffix
from kerbline.llm.bwt import Shard, merge, repeated_starts
from kerbline.llm.work import documents


def brute_removed(texts, length):
    """For each text, a flag for every byte."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        out.append(flags)
    return out


def test_merged_order_is_the_order_of_suffixes():
    rng = random.Random(4)
    for depth in (7, 8, 12, 40):
        strings = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(0, 50))) for _ in range(9)]
        shards = [Shard(strings[i::3], depth) for i in range(3)]
        order, classes, source = merge(shards, depth)
        text = [s for i in range(3) for s in strings[i::3]]
        suffixes = [t[i:] for t in text for i in range(len(t) + 1)]
        keys = [suffixes[i][:depth] for i in order]
        # symbols are compared with a terminator below all bytes
        ranks = [tuple(b + 1 for b in k) + ((0,) if len(k) < depth else ()) for k in keys]
        assert ranks == sorted(ranks)
        assert len(source) == len(suffixes)
        for s in shards:
            assert len(s.transform) == len(s.symbols) == len(set(s.order.tolist()))
        assert all((classes[a] == classes[b]) == (ra == rb) for (a, ra), (b, rb) in zip(zip(order, ranks), zip(order[1:], ranks[1:]))
                   if len(ra) == depth and ra[-1])


def test_repeated_starts_with_weights_and_shards():
    rng = random.Random(1)
    for _ in range(80):
        depth = rng.choice([8, 9, 20])
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 8))]
        weights = np.array([rng.choice([1, 1, 2]) for _ in strings])
        seen = Counter()
        for s, w in zip(strings, weights):
            for i in range(len(s) - depth + 1):
                seen[s[i : i + depth]] += w
        got = repeated_starts(strings, weights, depth, shard_bytes=30)
        assert all([seen[s[i : i + depth]] > 1 for i in range(len(s) - depth + 1)] == g.tolist() for s, g in zip(strings, got))


def compare(rows, given, length):
    removed = brute_removed([(t or "").encode() for _, t in given], length)
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], bytes(r["kept"]), len(r["removed"])) for r in rows)
    wanted = []
    for (i, t), flags in zip(given, removed):
        data = (t or "").encode()
        spans = sum(1 for k in range(len(data)) if flags[k] and (k == 0 or not flags[k - 1]))
        wanted.append((i is None, i or 0, len(data), sum(flags), bytes(b for b, f in zip(data, flags) if not f), spans))
    assert found == sorted(wanted)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 8))) for _ in range(n))


@pytest.mark.parametrize("batch", [suffix.BATCH_BYTES, 2000])
def test_documents_against_brute_force(make_docs, monkeypatch, batch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", batch)
    rng = random.Random(7)
    passage, line = prose(rng, 60), prose(rng, 30)
    given = [(i, prose(rng, rng.randrange(0, 120)) + (passage if i % 3 == 0 else "") + prose(rng, 20) + (line * 2 if i % 5 == 0 else ""))
             for i in range(60)]
    long = prose(rng, 4000)
    given += [(100, long), (101, long[:9000] + "!" + long[9000:]), (102, "ab" * 900), (103, "a" * 700), (104, "a" * 120), (105, "ab" * 50)]
    given += [(None, passage), (None, None), (200, ""), (7, given[7][1]), (7, given[7][1])]  # nulls and repeated rows
    compare(suffix.remove_repeats(make_docs(given), length=100).collect(), given, 100)


def test_given_table_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    compare(suffix.remove_repeats(docs).collect(), given, 400)


def test_text_of_whole_characters_and_empty_tables(make_docs):
    shared = "a" * 450
    rows = suffix.remove_repeats(make_docs([(1, "b" + shared + "é1"), (2, "c" + shared + "è2")]), length=400, as_text=True).collect()
    assert sorted(r["kept"] for r in rows) == ["b1", "c2"]  # è and é share their first byte: the match cuts them in two
    assert suffix.remove_repeats(make_docs([])).collect() == []
    assert [r["n_removed"] for r in suffix.remove_repeats(make_docs([(1, None), (2, "short")])).collect()] == [0, 0]


def test_contexts_of_a_large_batch_come_in_slices():
    """A worker passes places on every SLICE_ROWS documents, however large the batch that Spark hands over."""
    import pyarrow as pa

    rng = random.Random(3)
    n, common = 2 * suffix.SLICE_ROWS + 7, bytes(rng.randrange(256) for _ in range(450))
    texts = [bytes(rng.randrange(256) for _ in range(20)) + common for _ in range(n)]
    anchors = []
    for t in texts:
        places, _ = suffix.doc_anchors(suffix._hashes(t), 400)
        anchors.append([{"place": p, "n": n} for p in places.tolist() if p >= 20])
    kind = pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts, pa.binary()), pa.array(anchors, kind)],
                                       names=["_ka", "_kb", "_bytes", "anchors"])
    out = [b.to_pylist() for b in suffix._find_contexts(400)(iter([batch.slice(0, 3), batch.slice(3)]))]
    places = [{r["_ka"] for r in b} for b in out if b[0]["kind"] == "place"]
    assert len(places) == 4 and max(map(len, places)) <= suffix.SLICE_ROWS and set().union(*places) == set(range(n))
    contexts = [r for b in out for r in b if r["kind"] == "context"]
    assert sum(r["weight"] for r in contexts) == sum(len(b) for b in out) - len(contexts)
    assert {r["digest"] for r in contexts} == {r["digest"] for b in out for r in b if r["kind"] == "place"}
    whole = [r for r in contexts if common in r["bytes"]]
    assert all(texts[r["_ka"]][r["start"]:].startswith(c["bytes"]) for c in whole for b in out for r in b
               if r["kind"] == "place" and r["digest"] == c["digest"])
