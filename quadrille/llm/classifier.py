"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text (byte classes, words, lines, repetition) are transformed (logs of
counts, roots of shares) to be nearer to normal.  Each class has a mean and a covariance shrunk
towards the pooled one and towards its diagonal; its Cholesky factor is computed once on the
driver and shipped, and the score is the logistic of the difference of the two Mahalanobis
log densities, tempered so that it stays a usable probability.

The sums that the fit needs (counts, sums, cross products per class: 2 * (1 + d + d*d) numbers)
are aggregated over all labelled rows of the training folds, so the fit has no sample and no cap.
Training rows are those whose crc32(doc_id as text) mod 4 is not 2.  Inputs of a score are the
text's statistics only.

Defined results: null, empty and blank texts get a score like any other (all counts 0); a null
doc_id is not held out and never trained on; with no labels of one class the score is 0.5 for
every document; repeated rows get repeated rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FEATURES = ("words", "word_len", "long_word", "upper", "digit", "symbol", "bang", "pipe", "stop_mark", "other_ascii", "non_ascii", "space", "line_words", "dup_lines", "distinct_words", "top_word", "end_symbol", "repeat_pairs")
POOL, DIAGONAL, TEMPER, THRESHOLD = 0.3, 0.1, 1.0, 0.7
FOLDS, HELD_OUT = 4, 2
#: Bits of the map of labelled ids: 2 MB for any number of labels.
BITS = 1 << 24

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_=+\\", b"!?", b"|", b".,;:", b"\"'()[]{}/-`"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[list(b" \t\n\x0b\x0c\r")] = 8
_CLASS[128:] = 9
_END_SYMBOL = re.compile(rb"[#*$%&|<>!]+(?=[ \t\n\x0b\x0c\r]|$)")


def document_statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10) / max(n, 1)
    words = raw.split()
    w = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    body = n * (1 - share[8])
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    return [
        math.log1p(len(words)), math.log1p(body / w), sum(len(x) > 24 for x in words[:]) / w,
        share[1] ** 0.5, share[2] ** 0.5, share[3] ** 0.5, share[4] ** 0.5, share[5] ** 0.5, share[6] ** 0.5, share[7] ** 0.5, share[9] ** 0.5, share[8],
        math.log1p(len(words) / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), len(counts) / w, max(counts.values(), default=0) / w,
        (len(_END_SYMBOL.findall(raw)) / w) ** 0.5, 1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([document_statistics(t) for t in text])


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Discriminant:
    """Class means and cached inverse Cholesky factors; score(X) is the probability of class 1."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        d = len(FEATURES)
        self.ready = all(sums.get(c, (0,))[0] >= 2 for c in (0, 1))
        if not self.ready:
            return
        total = sum(s[0] for s in sums.values())
        self.mean = {c: s[1] / s[0] for c, s in sums.items()}
        cov = {c: s[2] / s[0] - np.outer(self.mean[c], self.mean[c]) for c, s in sums.items()}
        pooled = sum(cov[c] * sums[c][0] for c in sums) / total
        floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
        self.factor, self.offset = {}, {}
        for c in sums:
            alone = sums[c][0] / (sums[c][0] + 10 * d)  # few rows of a class: more of the pooled matrix
            mixed = (1 - POOL) * alone * cov[c] + (1 - (1 - POOL) * alone) * pooled
            shrunk = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed)) + 1e-3 * floor
            chol = np.linalg.cholesky(shrunk)
            self.factor[c] = np.linalg.inv(chol)
            self.offset[c] = -np.log(np.diag(chol)).sum() + math.log(sums[c][0] / total)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        log = {c: self.offset[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1) for c in (0, 1)}
        return 1 / (1 + np.exp(-np.clip(TEMPER * (log[1] - log[0]), -700, 700)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """stats: doc_id, x.  All labelled rows of the training folds count, through sums of each class."""
    d = len(FEATURES)
    y = labels.select(F.col("doc_id").alias("__d"), F.col("quality").alias("y")).where(F.col("y").isin(0, 1))
    rows = stats.where(fold(F.col("doc_id")) != HELD_OUT).join(y, F.col("doc_id") == F.col("__d"))
    cross = [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    got = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)], *cross).collect()  # two rows
    sums = {}
    for r in got:
        c = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        sums[int(r["y"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), c)
    return Discriminant(sums)


def scorer(model: Discriminant):
    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(x.to_numpy())) if len(x) else [], dtype="float64")

    return score


def _labelled(docs: DataFrame, labels: DataFrame):
    """Whether a row of docs may have a label: true for all that have one, and for a few others whose hash is that of one.

    A map of BITS hashes decides, so that no text is shuffled to meet its label.  Ids of two types, or of types whose
    equal values may hash apart, are left to the join.
    """
    kind = docs.schema["doc_id"].dataType
    if kind != labels.schema["doc_id"].dataType or kind not in (T.LongType(), T.IntegerType(), T.StringType()):
        return F.lit(True)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1
    known = labels.where(F.col("quality").isin(0, 1)).select(place.alias("p"))
    # BITS / 32768 rows of 4 KB
    parts = known.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    whole = np.zeros(-(-BITS // 32768) * 4096, np.uint8)
    for r in parts:
        whole[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf(T.BooleanType())
    def known_place(p: pd.Series) -> pd.Series:
        at = p.to_numpy() - 1
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return known_place(place)


def train(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Only labelled documents, and the few that share a hash with one, are read into statistics here; fit() joins the labels exactly."""
    common.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != HELD_OUT).where(_labelled(docs, labels))
    return fit(rows.select("doc_id", _statistics("text").alias("x")), labels)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    common.small_batches(docs.sparkSession)
    stats = common.materialize(docs.select("doc_id", _statistics("text").alias("x")), "doc-stats")
    score = scorer(fit(stats, labels))
    out = stats.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of quality 1; all columns of docs."""
    score = scorer(train(docs, labels))
    return docs.where(score(_statistics("text")) >= THRESHOLD)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
