"""Groups of spelling variants by PartEnum signatures over letter multisets.

The letters of a word, each with its count, are a binary vector: one dimension for every letter and occurrence. One inserted
or deleted letter changes one dimension, one replaced letter two. The letters are dealt to PARTS parts; two vectors at a
Hamming distance of at most two differ in at most two parts, so they agree on all others. Each word therefore gets one
signature for every pair of parts left out: its sorted letters without those parts. Words that are near share a signature;
words that share one are verified by their edit distance.

Everything runs on built-in functions. Words are counted before they are shuffled, and only words that are counted often
enough get signatures, so what is joined grows with the vocabulary, not with the text. A pair is verified under each signature that it shares
and then kept once. Forms are followed by doubling: each round goes twice as far as the one before.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.work import stored

PARTS = 8  # 28 signatures a word, each without a quarter of the letters
LETTERS = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]]
RUN = "[a-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDITED = 97  # a run whose hash this divides loses a letter


def words(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of letters in whole texts, lower-cased from A to Z only, of `length` letters and `least` occurrences.

    A run whose crc32 of "<id>:<run>" is a multiple of EDITED loses the letter at that hash modulo its length. A null text has
    no runs; a null id counts as empty. Repeated rows count each. Other columns are not looked at.
    """
    lowered = F.translate(F.col(text), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(row_id).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= length).select("run", F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EDITED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def signatures(vocabulary: DataFrame, parts: int = PARTS) -> DataFrame:
    """(part pair, signature, word), one row for each pair of parts that is left out."""
    dealt = ["".join(c for c in LETTERS if ord(c) % parts == i) for i in range(parts)]
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    left = [F.struct(F.lit(n).alias("without"), F.translate(F.col("sorted"), dealt[i] + dealt[j], "").alias("signature"))
            for n, (i, j) in enumerate(combinations(range(parts), 2))]
    return (vocabulary.select("word", ordered.alias("sorted")).select("word", F.explode(F.array(*left)).alias("s"))
            .select("s.without", "s.signature", "word"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, b), a < b: words of the table that differ by exactly one inserted, deleted or replaced letter, each pair once."""
    s = stored(signatures(vocabulary), "signatures")
    a = s.withColumnRenamed("word", "a")
    b = s.withColumnRenamed("word", "b")
    met = a.join(b, ["without", "signature"]).where(F.col("a") < F.col("b"))
    close = F.abs(F.length("a") - F.length("b")) <= 1
    return met.where(close & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following the forms ends. Forms must not lead back."""
    to = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        to = step.select("word", "root")


def variants(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = 5, least: int = 3) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word that `words` counts.

    `form` is the near word with the largest count (ties: smallest in code-point order) if that is at least twice the word's
    own; `root` is where forms lead, the word itself without a form. An empty table, or one without frequent words, gives no
    rows.
    """
    vocabulary = stored(words(docs, row_id, text, length, least), "vocabulary")
    pairs = stored(near_words(vocabulary), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    known = vocabulary.join(best, "word", "left")
    strong = -F.col("best.minus") >= 2 * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"),
                                F.when(strong, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
