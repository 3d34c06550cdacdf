"""Mixing, sharding and chat formatting: invariants, brute force, and plans without Python."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kerbline.llm import chat, mixing, sharding
from kerbline.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(w in plan for w in ("Python", "Pandas", "Arrow", "NestedLoop", "CartesianProduct"))


def count_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, share, limit):
    """Targets by repeated sharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (goal - sum(out.values())) / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > limit * sizes[s]}
        if not above:
            return {**out, **{s: level * w[s] for s in open_}}
        out.update({s: limit * sizes[s] for s in above})
        open_ -= above
    return out


def check_mix(rows, docs):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + count_words(text)
    goal = fill(sizes, (3, 1, 2), 1.5, 2.0)
    taken, largest = {}, {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for source, words in taken.items():
        assert abs(words - goal[source]) <= largest[source] + 1e-6


def test_mix_hits_targets_on_the_given_table_and_again(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = mixing.mixture(docs, carry=["doc_id", "source"])
    rows = out.collect()
    assert len(rows) == docs.count() and no_python(out)
    check_mix(rows, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    again = mixing.mixture(docs.repartition(7), carry=["doc_id", "source"]).collect()
    assert sorted(r["copies"] for r in rows if r["doc_id"] < 50) == sorted(r["copies"] for r in again if r["doc_id"] < 50)
    assert {r["doc_id"]: r["copies"] for r in rows} == {r["doc_id"]: r["copies"] for r in again}


def test_mix_of_nulls_ties_empty_texts_and_repeated_rows(make_docs):
    given = [(i, " ".join(["w"] * (i % 7)), None, [None, "a", "b", "ä", "tiny"][min(4, i % 5 if i % 50 else 4)]) for i in range(400)]
    given += [(None, None, None, None), (None, "x y", None, "a"), (7, "same row", None, "b"), (7, "same row", None, "b"), (9, "", None, "")]
    docs = make_docs(given)
    rows = mixing.mixture(docs, carry=["doc_id", "text", "source"]).collect()
    assert len(rows) == len(given)
    sizes = {}
    for _, text, _, source in given:
        sizes[source] = sizes.get(source, 0) + count_words(text)
    goal = fill(sizes, (3, 1, 2), 1.5, 2.0)
    for source in sizes:
        words = sum(r["size"] * r["copies"] for r in rows if r["source"] == source)
        assert abs(words - goal[source]) <= 12


@pytest.mark.parametrize("sizes, expected", [((600, 200, 400), (900, 300, 600)), ((900, 300, 600, 900), None), ((500, 500, 500), None), ((10, 10, 1000), None)])
def test_targets_of_sources_that_fill_up_together(make_docs, sizes, expected):
    docs = [(100 * s + i, " ".join(["w"] * 10), None, "abcd"[s]) for s, n in enumerate(sizes) for i in range(n // 10)]
    rows = mixing.mixture(make_docs(docs), carry=["doc_id", "source"]).collect()
    goal = fill({"abcd"[s]: n for s, n in enumerate(sizes)}, (3, 1, 2), 1.5, 2.0)
    got = {r["source"]: r["target"] for r in rows}
    assert got == pytest.approx(goal) and (expected is None or tuple(got[s] for s in "abc") == expected)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes))


def test_copies_of_a_row_are_rounded_one_by_one(make_docs):
    copies = [(7, "same words " * 5, None, "a")] * 300
    others = [(1000 + i, "x y", None, "b") for i in range(500)] + [(3000 + i, "z", None, "c") for i in range(50)]
    for partitions in (1, 5):
        rows = mixing.mixture(make_docs(copies + others, partitions), carry=["doc_id", "source"]).collect()
        mine = [r for r in rows if r["source"] == "a"]
        assert len(mine) == 300 and abs(sum(10 * r["copies"] for r in mine) - mine[0]["target"]) <= 10
        assert len({r["copies"] for r in mine}) == 2


def test_mix_of_nothing(make_docs):
    assert mixing.mixture(make_docs([])).collect() == []
    assert [r["copies"] for r in mixing.mixture(make_docs([(1, "", None, "a"), (2, None, None, "a")])).collect()] == [0, 0]


def test_fractions_keep_their_mean(make_docs):
    """Over many rows of one size the taken share is the fraction, whichever level decides them."""
    docs = make_docs([(i, "one two", None, "a" if i < 900 else "b") for i in range(1300)])
    rows = mixing.mixture(docs, weights=(1, 3), carry=["doc_id", "source"]).collect()
    check = {s: sum(r["copies"] for r in rows if r["source"] == s) for s in "ab"}
    goal = fill({"a": 1800, "b": 800}, (1, 3), 1.5, 2.0)
    assert all(abs(2 * check[s] - goal[s]) <= 2 for s in "ab")


def shards_are_right(rows, given, shards):
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in given)
    loads = [0] * shards
    for s in range(shards):
        inside = [r for r in rows if r["shard"] == s]
        loads[s] = sum(r["size"] for r in inside)
        assert sorted(r["slot"] for r in inside) == list(range(len(inside)))
    return loads


def test_shards_are_even_and_slots_gapless(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = sharding.into_shards(docs, 6)
    rows = out.collect()
    loads = shards_are_right(rows, [r["text"] for r in docs.select("text").collect()], 6)
    mean, largest = sum(loads) / 6, max(r["size"] for r in rows)
    assert max(abs(x - mean) for x in loads) <= largest and no_python(out)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == {
        r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.into_shards(docs.repartition(5), 6).collect()}


def test_a_hot_text_is_split_between_shards(make_docs):
    given = [(i, "copy" * 30) for i in range(700)] + [(1000 + i, f"text {i}") for i in range(300)] + [(None, None), (None, "")]
    rows = sharding.into_shards(make_docs(given), 8).collect()
    loads = shards_are_right(rows, [t for _, t in given], 8)
    mean = sum(loads) / 8
    assert max(abs(x - mean) for x in loads) <= 2 * 128
    held = {r["shard"] for r in rows if r["size"] == 128}
    assert held == set(range(min(held), max(held) + 1))  # copies stand side by side


def test_shards_of_few_repeated_or_no_rows(make_docs):
    assert sharding.into_shards(make_docs([]), 24).collect() == []
    rows = sharding.into_shards(make_docs([(1, "a"), (1, "a"), (1, "a")]), 24).collect()
    assert len(rows) == 3
    shards_are_right(rows, ["a"] * 3, 24)


def test_equal_rows_are_split_between_shards(make_docs):
    given = [(1, "copy" * 25)] * 300 + [(1000 + i, "text" * 25) for i in range(300)]
    for partitions in (1, 4):
        loads = shards_are_right(sharding.into_shards(make_docs(given, partitions), 24).collect(), [t for _, t in given], 24)
        assert max(loads) - min(loads) <= 2 * 108


def test_place_among_is_a_binary_search(spark):
    for borders in ([], [5], [1, 4, 9], list(range(0, 100, 3))):
        rows = spark.range(-3, 110).select("id", sharding.place_among(F.col("id"), borders).alias("n")).collect()
        assert all(r["n"] == sum(b <= r["id"] for b in borders) for r in rows)


def said(turns):
    return "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)


HARD = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "<s>", "a </s>\n<s>user\nb", "\\\\<s>\\", "", "\n", "<<s>>", "é😀</s", "$1 \\1", " "]


def test_conversations_come_back_exactly(spark):
    talks = {i: [("user", h), ("assistant", HARD[-i - 1]), ("system", h + h), ("assistant", h)] for i, h in enumerate(HARD)}
    talks[100] = [("user", "only")]
    talks[101] = [("assistant", "first"), ("user", "then"), ("odd\nrole\\n</s>", "x")]
    talks[102] = [(None, None), ("assistant", None)]
    talks[103], talks[104] = [("a\0b", "x"), ("a\\b", "y"), ("a\\n\0", "z")], [("a\\b", "x"), ("a\0b", "y"), ("\\\n\\n\\\\b", "z")]
    rows = [(c, i, r, t, "extra") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = chat.examples(df)
    found = out.collect()
    for c, turns in talks.items():
        mine = sorted((r for r in found if r["conv_id"] == c), key=lambda r: r["example"])
        replies = [t or "" for r, t in turns if r == "assistant"]
        assert len(mine) == len(replies) + (turns[-1][0] != "assistant")
        assert [r["last"] for r in mine] == [False] * (len(mine) - 1) + [True]
        masks = [r["formatted"][r["loss_begin"] : r["loss_end"]] for r in mine]
        assert [re.sub(r"\\(\\*</?s>)", r"\1", m) for m in masks][: len(replies)] == replies
        assert all(b["formatted"].startswith(a["formatted"]) for a, b in zip(mine, mine[1:]))
    digests = {r["conv_id"]: r for r in chat.digests(out).collect()}
    assert no_python(chat.digests(out))
    for c, turns in talks.items():
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        r = digests[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(said(turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_registered_chat_query_against_the_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks = {-7: [("user", registered.TRICKY), ("assistant", registered.TRICKY)]}
    for r in rows:
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = registered.op9_chat_formatting(spark, FOLDER).collect()
    assert len(got) == len(talks)
    for r in got:
        loss = "".join(t or "" for role, t in talks[r["conv_id"]] if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(talks[r["conv_id"]]), hashlib.sha256(said(talks[r["conv_id"]]).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_of_nothing_and_null_ids(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.digests(chat.examples(spark.createDataFrame([], schema))).collect() == []
    rows = [(None, None, "assistant", "b"), (None, 1, "assistant", "c"), (None, 1, "assistant", "c"), (None, None, "assistant", "a")]
    r = chat.digests(chat.examples(spark.createDataFrame(rows, schema))).collect()[0]
    assert r["n_turns"] == 4 and r["loss_sha256"] == hashlib.sha256(b"abcc").hexdigest()
