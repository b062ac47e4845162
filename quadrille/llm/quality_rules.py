"""Quality rules with risk-controlled thresholds.

Base rules are fixed.  Beyond them, each rule is a statistic of the text and a cutoff above which
a document is rejected.  A cutoff is used in a stratum (language) only if labelled holdouts prove,
by an exact binomial bound, that it rejects few good documents there: with k of the stratum's n
good holdouts rejected, P(Binomial(n, risk) <= k) <= delta / tests.  ``tests`` counts every
(stratum, rule, cutoff) tried (Bonferroni), and the permitted ``RISK`` of a stratum is split evenly
over the rules, so that with confidence 1 - delta all cutoffs in use together reject at most
``RISK`` of the good documents of every stratum.  Of the proven cutoffs the strictest is taken;
where there is none (too few labels) the rule stays off.  The grid is fixed beforehand, as the
bound demands.

Everything is DataFrame functions.  Repeated eight-word windows are found inside the row: hashes of
windows by doubling (1, 2, 4, 8 words), then, only where hashes repeat, a sort of (hash, place).

Defined results: null and blank texts have no words and fail the base rules; null lang is a
stratum of its own; rows repeated in full give repeated rows; a doc_id with several labels counts
once per label; without labels no cutoff is proven and kept = not base_failed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RISK, DELTA = 0.05, 0.05
GRID = {
    "symbol_ratio": (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "dup_line_ratio": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
    "upper_ratio": (0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
}
#: Up to this many rejected holdouts the tail is summed from its first term.
SMALL = 1000
SYMBOLS = "#*$%&|<>"


def _windows_hash(df: DataFrame, width: int = 8) -> DataFrame:
    """Turns column g, hashes of words, into hashes of windows of `width` (a power of two) words.

    Each level is a projection of its own: inside one expression the arrays would be made anew for
    each reference.
    """
    step = 1
    while step < width:
        n = F.size("g") - step
        both = F.zip_with(F.slice("g", F.lit(1), n), F.slice("g", F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn("g", F.when(n > 0, both).otherwise(F.array().cast("array<bigint>")))
        step *= 2
    return df


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select("doc_id", "lang", text.alias("t"), common.words(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(common.WS_CHARS)) != "")
    a = a.select("doc_id", "lang", "t", "w", lines.alias("l"))
    bare = F.translate("t", common.WS_CHARS, "")
    upper = F.length(bare) - F.length(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    b = a.select(
        "doc_id", "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        upper.cast("long").alias("n_upper"),
        F.when(F.size("w") >= 9, F.transform("w", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    b = _windows_hash(b)
    # places of windows whose hash is also at another place, in order
    pairs = F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("g")) < F.size("g")
    c = b.withColumn("s", F.when(twice, pairs)).drop("g")
    n = F.size("s")
    same = F.filter("s", lambda x, k: (F.when(k > 0, F.element_at(F.col("s"), k)["h"] == x["h"]).otherwise(F.lit(False))) | (F.when(k + 1 < n, F.element_at(F.col("s"), F.least(k + 2, n))["h"] == x["h"]).otherwise(F.lit(False))))
    d = c.withColumn("p", F.sort_array(F.transform(same, lambda x: x["i"]))).drop("s")
    m = F.size("p")
    covered = F.aggregate(F.sequence(F.lit(1), m), F.lit(0), lambda acc, k: acc + F.when(k < m, F.least(F.lit(8), F.element_at(F.col("p"), F.least(k + 1, m)) - F.element_at(F.col("p"), k))).otherwise(F.lit(8)))
    return d.withColumn("n_repeat_words", F.when(F.col("p").isNotNull() & (m > 0), covered).otherwise(F.lit(0)).cast("long")).drop("p")


def rule_values(stats: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return stats.withColumns({
        "symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "upper_ratio": ratio("n_upper", "word_chars"),
        "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
    })


def _stirling(x):
    """What Stirling's formula lacks of log x!, for x of some hundreds and more."""
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def binomial_tail(n, k, p):
    """P(Binomial(n, p) <= k); 1 where k >= n * p, which proves nothing.

    Logs of terms are summed up from 0 where k is small.  Where it is not, they are summed down from
    k, whose own log is taken by Stirling's formula, until what is left is below 1e-18 of the sum:
    terms fall at least by the ratio of the first two.  Either way it is the whole sum.
    """
    first = n * F.log(1 - p)
    step = lambda acc, i: F.struct(
        (acc["t"] + F.log((n - i + 1) / i) + F.log(p / (1 - p))).alias("t"),
        (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1) / i) + F.log(p / (1 - p)))).alias("s"))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))
    count = lambda m: F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1)).cast("long"))
    up = F.when(k < 1, F.exp(first)).otherwise(F.aggregate(count(F.least(k, F.lit(SMALL))), start, step, lambda a: a["s"]))
    x, m = k.cast("double"), n.cast("double")
    log_k = (0.5 * F.log(m / (2 * math.pi * x * (m - x))) + _stirling(m) - _stirling(x) - _stirling(m - x)
             - x * F.log(x / (m * p)) - (m - x) * F.log((m - x) / (m * (1 - p))))
    ratio = x * (1 - p) / ((m - x + 1) * p)
    terms = F.least(k, F.ceil(F.lit(math.log(1e-18)) / F.log(ratio)) + F.ceil(1 / (1 - ratio)))
    down_step = lambda acc, j: F.struct(
        (acc["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("t"),
        (acc["s"] + acc["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("s"))
    down = F.exp(log_k) * F.aggregate(count(terms), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), down_step, lambda a: a["s"])
    return F.when(n < 1, F.lit(1.0)).when(k >= n * p, F.lit(1.0)).when(k > SMALL, down).otherwise(up)


def cutoffs(values: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, grid=GRID) -> DataFrame:
    """stratum, then for each rule the proven cutoff (null: off).  One row per stratum."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("d2"))
    held = values.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("d2"))
    counts = [F.count(F.when(F.col(r) > c, 1)).alias(f"{r}|{j}") for r, cs in grid.items() for j, c in enumerate(cs)]
    per = held.groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *counts)
    strata = values.select("lang").distinct().agg(F.count(F.lit(1)).alias("strata"))
    per = per.join(strata)  # a single row beside one row per stratum
    tests = F.col("strata") * sum(map(len, grid.values()))
    own = F.lit(risk / len(grid))
    proven = lambda r, j: binomial_tail(F.col("n"), F.col(f"`{r}|{j}`"), own) <= F.lit(delta) / tests
    return per.select("stratum", *[F.least(*[F.when(proven(r, j), F.lit(c)) for j, c in enumerate(cs)]).alias(f"cut_{r}") for r, cs in grid.items()])


def verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    stats = common.materialize(statistics(docs.select("doc_id", "lang", "text")), "rule-stats")
    values = rule_values(stats)
    cuts = cutoffs(values, labels.select("doc_id", "quality"), **options)
    grid = options.get("grid", GRID)
    out = values.join(cuts, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    bad = F.lit(False)
    for r in grid:
        bad = bad | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~bad)


def query(spark, sf_dir: str) -> DataFrame:
    v = verdicts(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    rules = [(r, j, c) for r, cs in GRID.items() for j, c in enumerate(cs)]
    own = RISK / len(GRID)
    grid = ", ".join(f"('{r}', {c}::DOUBLE)" for r, _, c in rules)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS rid FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 9)),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM p) GROUP BY rid),
b AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_ratio, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_ratio FROM b),
grid(rule, cut) AS (VALUES {grid}),
h AS (SELECT v.* FROM v JOIN labels USING (doc_id) WHERE NOT base_failed AND quality = 1),
k AS (SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (CASE rule {" ".join(f"WHEN '{r}' THEN {r}" for r in GRID)} END > cut) AS k FROM h, grid GROUP BY ALL),
z AS (SELECT k.*, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({own}) + (n - i) * ln(1 - {own}))) FROM (SELECT unnest(generate_series(0, k.k)) AS i)) AS tail FROM k),
c AS (SELECT lang, rule, min(cut) AS cut FROM z WHERE k < n * {own} AND tail <= {DELTA} / ((SELECT count(DISTINCT coalesce(lang, chr(0))) FROM v) * {len(rules)}) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang IS NOT DISTINCT FROM v.lang
  AND CASE rule {" ".join(f"WHEN '{r}' THEN v.{r}" for r in GRID)} END > c.cut) AS kept FROM v
"""


SQL = _sql()
