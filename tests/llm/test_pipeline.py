"""The pipeline over awkward tables, and its passages of fifty to seventy words."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm.suffix import remove_repeats
from kerbline.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _ka string, _row string, copies string, size string"


def _folder(spark, rows, labels):
    folder = shared_dir(spark, "corpus")
    full = [(i, t, lang, source, None if t is None else len(t), "a", "b", "c", "d") for i, t, lang, source in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _words(rng, n):
    return " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(4)
    rows = [(i, _words(rng, 60) + ".", rng.choice(["en", None]), rng.choice(["a", "b", None])) for i in range(80)]
    rows += [(100 + i, "|| ## 0x0 || " * 30, "en", "b") for i in range(30)]
    rows += [rows[3]] * 4 + [(None, None, None, None), (None, "", "en", "a"), (200, None, "en", "b"), (201, "", None, None), (202, "one two", "en", "a")]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(25)] + [(None, 1, None), (5, None, None), (3, 1, 0)]
    out = corpus_pipeline.run(spark, _folder(spark, rows, labels))
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"]
    got = out.collect()
    kept = {r["doc_id"] for r in got}
    assert kept <= {r[0] for r in rows} and not kept & set(range(100, 130)) and len(kept & set(range(80))) > 40
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    # the same rows in another arrangement give the same corpus
    again = corpus_pipeline.run(spark, _folder(spark, rows[::-1], labels[::-1]))
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == sorted(str((r["doc_id"], r["ids"])) for r in again.collect())


def test_no_documents(spark):
    folder = _folder(spark, [], [(1, 1, 0), (2, 0, 0)])
    assert corpus_pipeline.mixing_stage(spark, corpus_pipeline.suffix_dedup_stage(spark, corpus_pipeline.near_dedup_stage(
        spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), folder), folder).count() == 0


def test_passages_of_fifty_words_go_and_the_rest_stays(spark):
    """Against brute force over all strings of the stage's length."""
    rng = random.Random(9)
    passages = [_words(rng, n) for n in range(51, 71)]
    texts = []
    for i in range(60):
        parts = [_words(rng, rng.randrange(5, 40)) for _ in range(3)]
        if i % 3:
            parts.insert(rng.randrange(4), passages[rng.randrange(len(passages))])
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup_stage(spark, docs.repartition(4), "").collect()}
    n, seen = corpus_pipeline.REPEAT, {}
    for i, t in enumerate(texts):
        for at in range(len(t) - n + 1):
            seen.setdefault(t[at : at + n], []).append((i, at))
    for i, t in enumerate(texts):
        gone = [False] * len(t)
        for at in range(len(t) - n + 1):
            if len(seen[t[at : at + n]]) > 1:
                gone[at : at + n] = [True] * n
        assert out[i] == "".join(c for c, g in zip(t, gone) if not g)
    twice = [p for p in passages if sum(p in t for t in texts) > 1]
    assert len(twice) >= 10 and not any(p in t for p in twice for t in out.values())
    assert remove_repeats(docs, length=n).where(F.col("n_removed") > 0).count() >= 30
