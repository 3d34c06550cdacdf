"""Quality by pairwise ranking: a Bradley-Terry model over text features.

The probability that document a is preferred to document b is the logistic function of w·(f(a) - f(b)). Preference pairs
put a labelled document of quality 1 before one of quality 0; w minimises the logistic loss over feature differences. A
document's strength is w·f. The weights come from a sample that is bounded in each class; the threshold does not: it is a
quantile of the strengths of all labelled documents, at the share of quality 0 among them. Strengths are mapped to 0..1 so
that the threshold falls on THRESHOLD.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.work import drawn, nth, stored

THRESHOLD = 0.7
TEXT_BYTES = 2 << 20
# byte classes whose shares are features: signs that prose rarely has, capitals, column bars, digits, bytes beyond ASCII
CLASSES = {"signs": b"!\"#$%&*+/<=>@[\\]^_`{}~", "capitals": bytes(range(65, 91)), "bars": b"|", "digits": bytes(range(48, 58)),
           "beyond": bytes(range(128, 256))}
BY_LINE = ("signs", "capitals", "bars")  # also the highest share in one line
LINE = 40  # bytes that a line counts as at least
NAMES = ([f"{c}_{m}" for c in CLASSES for m in ("share", "log")] + [f"{c}_line" for c in BY_LINE]
         + ["words_log", "word_length", "repeat_share", "repeat_log", "distinct", "top_word", "empty"])


def _flags() -> np.ndarray:
    table = np.zeros((len(CLASSES), 256), dtype=np.uint8)
    for i, members in enumerate(CLASSES.values()):
        table[i, list(members)] = 1
    return table


FLAGS = _flags()


def _some_features(texts: list[str]) -> np.ndarray:
    """One row of NAMES for each text."""
    data = [t.encode() for t in texts]
    out = np.zeros((len(texts), len(NAMES)), dtype=np.float64)
    joined = np.frombuffer(b"".join(d + b"\n" for d in data), dtype=np.uint8)
    lengths = np.array([len(d) for d in data])
    doc_begin = np.cumsum(lengths + 1) - lengths - 1
    line_end = np.flatnonzero(joined == 10)
    line_begin = np.append(0, line_end[:-1] + 1)
    first_line = np.searchsorted(line_begin, doc_begin)
    line_size = line_end - line_begin
    at = 0
    peaks = {}
    for i, name in enumerate(CLASSES):
        by_line = np.add.reduceat(FLAGS[i][joined], line_begin, dtype=np.int64)
        share = np.add.reduceat(by_line, first_line) / np.maximum(lengths, 1)
        out[:, at], out[:, at + 1] = share, np.log1p(100 * share)
        at += 2
        if name in BY_LINE:
            peaks[name] = np.maximum.reduceat(by_line / np.maximum(line_size, LINE), first_line)
    for name in BY_LINE:
        out[:, at] = peaks[name]
        at += 1
    for row, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            out[row, at + 6] = 1
            continue
        repeats = sum(map(operator.eq, words, words[1:])) / n
        seen = Counter(words)
        out[row, at : at + 6] = (math.log1p(n), min(30.0, len(text) / n), repeats, math.log1p(100 * repeats),
                                 len(seen) / n ** 0.8, max(seen.values()) / n)
    return out


def feature_rows(texts: list[str]) -> Iterator[np.ndarray]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TEXT_BYTES or i == len(texts) - 1:
            yield _some_features(texts[begin : i + 1])
            begin, size = i + 1, 0


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(text: pd.Series) -> pd.Series:
    """Features of a whole text; null counts as empty."""
    texts = ["" if t is None else t for t in text]
    return pd.Series([r for rows in feature_rows(texts) for r in rows], dtype=object)


@dataclass
class Ranking:
    """Weights per feature (already divided by its spread), the strength at the threshold, and the spread of strengths."""

    weights: list[float]
    cut: float
    scale: float


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = 40_000, rounds: int = 400, rate: float = 0.3, decay: float = 1e-4,
        seed: int = 3, quantile: float | None = None) -> Ranking:
    """Learn from feature rows of preferred and other documents. With only one kind every score is on one side."""
    if not len(good) or not len(bad):
        width = good.shape[1] if len(good) else bad.shape[1] if len(bad) else len(NAMES)
        return Ranking([0.0] * width, -1.0 if len(good) or not len(bad) else 1.0, 1.0)
    every = np.concatenate([good, bad])
    spread = every.std(axis=0)
    spread[spread == 0] = np.inf
    rng = np.random.default_rng(seed)
    difference = (good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]) / spread
    w = np.zeros(every.shape[1])
    speed = np.zeros_like(w)
    for _ in range(rounds):
        slope = -difference.T @ (1 / (1 + np.exp(np.clip(difference @ w, -50, 50)))) / pairs + decay * w
        speed = 0.9 * speed - rate * slope
        w += speed
    w = w / spread
    strength = np.sort(every @ w)
    share = len(bad) / len(every) if quantile is None else quantile
    # the threshold lies between the two strengths around the quantile
    at = min(len(strength) - 1, max(1, round(share * len(strength))))
    return Ranking(w.tolist(), float(strength[at - 1] + strength[at]) / 2, float(max(1e-6, strength.std())))


def strength(model: Ranking, feature: Column) -> Column:
    """w·f; native arithmetic on the feature array."""
    return sum((F.lit(w) * F.element_at(feature, i + 1) for i, w in enumerate(model.weights)), F.lit(0.0))


def score(model: Ranking, feature: Column) -> Column:
    """0..1, THRESHOLD at the model's cut."""
    steep = 4.0 / model.scale
    shift = math.log(THRESHOLD / (1 - THRESHOLD))
    return (1 / (1 + F.exp(-(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (strength(model, feature) - model.cut) * steep + shift)))))).cast("double")


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, row_id: str = "doc_id", text: str = "text", quality: str = "quality",
          per_class: int = 4_000, seed: int = 3) -> Ranking:
    """Fit on at most `per_class` labelled documents of each class, chosen by a hash of the id; set the cut by all of them.

    Labels that are null, or differ for one id, are not used; `allowed` says which ids may be learned from.
    """
    known = (labels.where(allowed & F.col(quality).isin(0, 1)).groupBy(F.col(row_id).alias("_id"))
             .agg(F.min(quality).alias("_low"), F.max(quality).alias("_high")).where("_low = _high and _id is not null"))
    known = known.select("_id", F.col("_low").alias("_label"), F.xxhash64(F.lit(5), "_id").alias("_drawn"))
    chosen = drawn(known, "_label", ["_drawn", "_id"], per_class).select("_id", "_label")
    # at most two times per_class ids: a broadcast of a proven size
    rows = (docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
            .select("_id", "_label", features("_text").alias("_f")).dropDuplicates(["_id"]).orderBy("_id").collect())
    table = lambda label: np.array([r["_f"] for r in rows if r["_label"] == label]).reshape(-1, len(NAMES))
    good, bad = table(1), table(0)
    model = fit(good, bad, seed=seed)
    return set_cut(docs, known, model, row_id, text) if len(good) and len(bad) else model


def set_cut(docs: DataFrame, known: DataFrame, model: Ranking, row_id: str = "doc_id", text: str = "text") -> Ranking:
    """`model` with cut and scale from all documents that `known` (_id, _label) labels, whatever sample the weights came from."""
    # strengths first: ids and numbers meet, texts do not travel
    every = stored(docs.select(F.col(row_id).alias("_id"), strength(model, features(F.col(text))).alias("_s"))
                   .join(known.select("_id", "_label"), "_id").select("_label", "_s"), "strengths")
    n, bad, scale = every.agg(F.count("*"), F.count_if(F.col("_label") == 0), F.stddev_pop("_s")).first()
    at = min(n - 1, max(1, bad))
    return replace(model, cut=(nth(every, "_s", at) + nth(every, "_s", at + 1)) / 2, scale=max(1e-6, scale))


def ranked(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """`docs` with a column _score; documents with an empty or null text get the score of their (zero) features."""
    return docs.withColumn("_score", score(model, features(F.col(text))))
