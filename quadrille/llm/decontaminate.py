"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

A benchmark item of n shingles counts as leaked into a document when the document holds at least
80% of the item's distinct five-word shingles.  Fixed numbers of minima a document cannot answer
that: an item of 30 shingles inside a document of 10,000 has a similarity of 0.0024, at which one
minimum agrees once in 420 times, so a miss below 1e-9 takes 8,700 minima for 10,000 shingles.
The signatures here are bounded by hash value instead, and the bound depends on the item's size:

1. Items are partitioned by size, in powers of two of their distinct shingles.
2. An item's signature is its k smallest hashes, k by (1 - threshold)^k <= ``MISS``: a leak of
   the threshold keeps one of them with probability 1 - ``MISS`` at least.  Items of up to k
   shingles keep all, so none of their leaks can be missed.
3. A partition's bound is the largest hash in the signatures of its items, near k/n of the range.
   A document's signature for the partition is the set of its minima up to that bound: the only
   hashes that could meet.  Items of 1,000 shingles ask for about 1.3% of a document's.
4. Documents that meet an item in a signature are candidates.  They are verified by the shingles
   themselves (strings, not hashes): all of the document's against all of the item's.

Words are taken after lower-casing A-Z.  Items of fewer than five words are one shingle as long as
they are.  Defined results: null, empty or blank texts have no shingle and match nothing; repeated
rows of either table give one pair; an empty table on either side gives an empty result.  In the
pairs a document is what has one doc_id (all rows with a null id count as one, their texts
together); ``clean`` looks at each doc_id and text on its own, so that rows which share an id, or
have none, stay or go by what they hold themselves.  Columns of any name pass through ``clean``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, THRESHOLD_PCT, MISS = 5, 80, 1e-9
#: Item sides of up to this many shingles (counted before) and ``BROADCAST_BYTES`` are replicated to the executors.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def minima(threshold_pct: int = THRESHOLD_PCT, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(threshold_pct, 99) / 100)))


def _places(docs: DataFrame, keys: tuple[str, ...], widths: list[int], words) -> DataFrame:
    """The keys, words, width, i: a row for each shingle of each width, in one pass over the texts."""
    w = docs.select(*keys, words.alias("words")).where(F.size("words") >= min(widths))
    if len(widths) > 1:
        w = w.withColumn("width", F.explode(F.array(*[F.lit(k) for k in widths]))).where(F.size("words") >= F.col("width"))
    else:
        w = w.withColumn("width", F.lit(widths[0]))
    return w.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)))


def _hash(width: int, i=None):
    """Of the hashes of words from place i on; words that are beyond the width count for nothing."""
    i = F.col("i") if i is None else i
    return F.xxhash64("width", *[F.when(F.col("width") > k, F.try_element_at("words", i + k)) for k in range(width)])


def _word_hashes(text):
    """Hashes of the words: each word is hashed once, and shingles are hashes of these."""
    return F.transform(common.words(common.ascii_lower(text)), lambda w: F.xxhash64(w))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, width, n (distinct shingles), shingle (text), h, rank (by h), part (of sizes)."""
    w = items.select("item_id", common.words(common.ascii_lower(F.col("text"))).alias("w")).where(F.size("w") >= 1)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width))).withColumn("words", F.transform("w", lambda x: F.xxhash64(x)))
    e = w.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)))
    e = e.select("item_id", "width", F.array_join(F.slice("w", F.col("i"), F.col("width")), " ").alias("shingle"), _hash(width).alias("h"))
    sets = e.groupBy("item_id", "width").agg(F.array_sort(F.collect_set(F.struct("h", "shingle"))).alias("s"))
    out = sets.select("item_id", "width", F.size("s").cast("long").alias("n"), F.posexplode("s").alias("rank", "x"))
    return out.select("item_id", "width", "n", "rank", "x.h", "x.shingle", F.floor(F.log2("n")).cast("int").alias("part"))


def _among(docs: DataFrame, found: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """A semi or anti join on the keys, of which null is a value."""
    other = found.select(*[F.col(c).alias(f"of_{c}") for c in keys]).distinct()
    return docs.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]), how)


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold_pct: int = THRESHOLD_PCT, miss: float = MISS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id (or the keys), item_id, n_item (shingles of the item), n_shared: one row per leaked item and document."""
    docs = docs.select(*keys, "text")
    table = common.materialize(item_shingles(items.select("item_id", "text"), width), "items")
    k = minima(threshold_pct, miss)
    # one row per width and power of two: at most width * 64
    parts = table.groupBy("width", "part").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("shingle")).alias("b"), F.max(F.when(F.col("rank") < k, F.col("h"))).alias("bound")).collect()
    if not parts:
        return table.select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in keys], "item_id", F.col("n").alias("n_item"), F.col("n").alias("n_shared")).limit(0)
    small = sum(p["c"] for p in parts) <= BROADCAST_ROWS and sum(p["b"] for p in parts) <= BROADCAST_BYTES
    near = F.broadcast if small else (lambda d: d)
    widths = sorted({p["width"] for p in parts})
    # search: a document's minima up to the bound of each partition, against the items' signatures there
    signatures = table.where(F.col("rank") < k).select("width", "part", "h", "item_id")
    hashed = _places(docs, keys, widths, _word_hashes(F.col("text"))).select(*keys, "width", _hash(width).alias("h"))
    bounds = sorted((p["width"], p["bound"], p["part"]) for p in parts)
    top = reduce(lambda a, b: a | b, [(F.col("width") == w) & (F.col("h") <= max(b for v, b, _ in bounds if v == w)) for w in widths])
    asked = F.array_compact(F.array(*[F.when((F.col("width") == w) & (F.col("h") <= b), F.lit(p)) for w, b, p in bounds]))
    minima_of = hashed.where(top).select(*keys, "width", "h", F.explode(asked).alias("part"))
    candidates = common.materialize(minima_of.join(near(signatures), ["width", "part", "h"]).select(*keys, "item_id").distinct(), "candidates")
    # verification by the shingles themselves, of the candidate documents only
    again = common.materialize(_among(docs, candidates, keys, "left_semi"), "candidate-texts")
    own = _places(again, keys, widths, common.words(common.ascii_lower(F.col("text"))))
    own = own.select(*keys, "width", F.array_join(F.slice("words", F.col("i"), F.col("width")), " ").alias("shingle"))
    exact = own.join(near(table.select("width", "shingle", "item_id", F.col("n").alias("n_item"))), ["width", "shingle"])
    shared = exact.select(*keys, "item_id", "n_item", "shingle").distinct().groupBy(*keys, "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n_item") * threshold_pct)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item; all columns of docs."""
    # two hashes: as good as the text itself
    keyed = common.carried(docs, doc_id=F.col("doc_id"), text=F.col("text"), t1=F.xxhash64("text"), t2=F.xxhash64(F.lit(WIDTH), "text"))
    keys = ("doc_id", "t1", "t2")
    return _among(keyed, leaks(keyed, items, keys=keys, **options), keys, "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, 'd' AS t FROM documents
  UNION ALL SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), 'i' FROM benchmark),
n AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE t = 'i' AND len(w) > 0),
s AS (SELECT DISTINCT t, id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT w.*, n.k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, n WHERE len(w) >= k AND (t = 'd' OR k = 5 OR len(w) = k))),
q AS (SELECT id, k, count(*) AS n FROM s WHERE t = 'i' GROUP BY ALL)
SELECT d.id AS doc_id, i.id AS item_id, q.n AS n_item, count(*) AS n_shared
FROM s d JOIN s i ON d.t = 'd' AND i.t = 'i' AND d.k = i.k AND d.g = i.g JOIN q ON q.id = i.id AND q.k = i.k
GROUP BY d.id, i.id, q.n HAVING count(*) * 100 >= q.n * 80
"""
