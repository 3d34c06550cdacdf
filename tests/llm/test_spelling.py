"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from kerbline.llm import queries as registered
from kerbline.llm import spelling
from tests.llm.test_native import no_python

FOLDER = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, length=5, least=3):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r[0], r[1] or "", r[2], r[3], r[4], r[5] or 0) for r in df.collect())


def asked(make_docs, rows):
    return spelling.variants(make_docs(rows)).select("word", "form", "root", "n", "n_near", "form_n")


def test_random_words_with_edits(spark, make_docs):
    rng = random.Random(3)
    letters = "abcdeé×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    rows = []
    for i in range(60):
        said = []
        for _ in range(80):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(letters)]])
                w = w or ["a"]
            said.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((i, rng.choice([" ", ", ", "1", "Ā"]).join(said)))
    assert found(asked(make_docs, rows)) == brute([r[:2] for r in rows])


def test_chains_of_forms_ties_and_anagrams(spark, make_docs):
    chain = ["abcdefgh", "abcdefg", "abcdef", "abcde"]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    rows += [(2, "listen silent enlist " * 40 + "tinsel listem listex " * 4), (3, "zzzzz zzzzy zzzzx " * 3), (None, "NULLE NULLE nulle nuller " * 3)]
    rows += [(5, None), (6, ""), (6, ""), (7, "1234 ..."), (8, "kurz fünf"), (9, "straße strasse STRASSE straßen " * 5)] * 2
    got = found(asked(make_docs, rows))
    assert got == brute([r[:2] for r in rows])
    assert dict((r[0], r[2]) for r in got)["abcdefgh"] == "abcde"


def test_very_long_text_and_no_words(spark, make_docs):
    rows = [(n, " ".join(f"longe{c}" for c in "abcdefgh") * 3000) for n in range(2)]
    assert found(asked(make_docs, rows)) == brute(rows)
    assert found(asked(make_docs, [])) == [] and found(asked(make_docs, [(1, "once twice"), (2, None)])) == []


def test_every_near_pair_shares_a_signature():
    """Two letters that differ touch two parts at most, so some pair of parts left out makes the words alike."""
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.choice(spelling.LETTERS) for _ in range(rng.randrange(5, 12))]
        b = list(a)
        b[rng.randrange(len(b))] = rng.choice(spelling.LETTERS)
        changed = {ord(c) % spelling.PARTS for c in (Counter(a) - Counter(b)) + (Counter(b) - Counter(a))}
        assert len(changed) <= 2


def test_registered_query_on_the_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    out = registered.op12_partenum_variants(spark, FOLDER)
    assert [f.dataType.simpleString() for f in out.schema] == ["string"] * 3 + ["bigint"] * 3 and no_python(out)
    assert found(out) == brute(docs)
