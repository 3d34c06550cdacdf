"""The conversation trie against brute force over prefixes, and the radix tree's layouts."""

import hashlib
import random
import zlib

import pytest

from kerbline.llm import queries as registered
from kerbline.llm import trie

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, ids string, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in talks.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + ts[h:]) if rebuild else tuple(ts)
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], set()).add(c)
    out = []
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        ends = sorted(c for c in convs if made[c] == prefix)
        out.append((min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs), sum(len(p) == len(prefix) + 1 for p in below),
                    sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
                    sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def built(spark, rows, turns=trie.TURNS, rebuild=True):
    df = spark.createDataFrame([(*r, "i", "k") for r in rows], SCHEMA).repartition(3)
    talks = trie.sequences(df)
    out = trie.nodes(trie.rebuilt(talks) if rebuild else talks, turns)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def random_talks(seed, convs, choices):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(choices)) for t in range(rng.randrange(1, 7))]
    return rows


@pytest.mark.parametrize("turns", [trie.TURNS, 40, 7])
def test_random_talks_in_one_or_many_ranges(spark, turns):
    rows = random_talks(turns, 90, ["a", "bé", ""])
    assert ordered(built(spark, rows, turns)) == ordered(brute(rows))
    rows = random_talks(turns + 1, 60, ["x", "y"])
    assert ordered(built(spark, rows, turns, rebuild=False)) == ordered(brute(rows, rebuild=False))


def test_copies_that_fill_several_ranges(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(3)]
    rows += [(50 + c, t, "user", f"t{t}") for c in range(3) for t in range(4)] + [(90, 0, "user", "t0"), (91, 0, "user", "z")]
    for turns in (9, 30, 1000):
        assert ordered(built(spark, rows, turns, rebuild=False)) == ordered(brute(rows, rebuild=False))


def test_nulls_ties_repeated_rows_and_missing_bases(spark):
    rows = [(11, None, None, "x"), (11, 3, "user", None), (11, 3, "user", None), (11, 3, "assistant", "b"), (None, 0, "user", "lost"), (-7, 0, "user", "n"),
            (-5, 1, "user", "m"), (-5, 0, "user", "n"), (0, 0, "", ""), (4, 0, None, None), (10**15, 2, "user", "x" * 5000), (9, 0, "us", "er:x"), (8, 0, "user", ":x")]
    assert ordered(built(spark, rows)) == ordered(brute(rows))
    # a base shorter than h leaves a conversation without turns
    rows = [(c, t, "user", f"{c}") for c in range(30) for t in range(1 if c % 5 == 0 else 2)] + [(c, 0, "u", "q") for c in range(31, 35)]
    assert any(r[1] == 0 for r in brute(rows)) and ordered(built(spark, rows)) == ordered(brute(rows))


def test_no_conversations(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []


def test_layouts_grow_and_find_every_key():
    rng = random.Random(4)
    for many in (3, 4, 5, 16, 17, 48, 49, 256):
        tree, keys = trie.Tree(), set()
        firsts = rng.sample(range(256), many)
        for f in firsts:
            keys |= {bytes([f]) * 16, bytes([f]) * 15 + b"\0" + bytes(16), bytes([7] * 5 + [f] + [0] * 10)}
        keys = sorted(keys)
        for n, k in enumerate(rng.sample(keys, len(keys))):
            tree.insert(k, n)
        for n in {n for k in keys for n in tree.along(k) if n.kids is not None}:
            held = len(list(n.kids.items()))
            room = {"Few": getattr(n.kids, "room", 0), "Indexed": 48, "Direct": 256}[type(n.kids).__name__]
            assert room == next(r for r in (4, 16, 48, 256) if r >= held)
        rows = list(tree.aligned())
        assert {depth for depth, *_ in rows} == {0, 1, 2} and sum(end >= 0 for _, _, _, end, _, _ in rows) == len(keys)
        assert len(rows) == 1 + len({k[:16] for k in keys}) + len({k for k in keys if len(k) == 32})
        assert sorted(b"".join([rows[p][2], turn]) for _, p, turn, end, _, _ in rows if end >= 0) == keys


def test_registered_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = registered.op13_prefix_trie(spark, FOLDER)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 7 + ["string"]
    assert ordered(tuple(r) for r in out.collect()) == ordered(brute(rows))
