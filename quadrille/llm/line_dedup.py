"""Line dedup: repeated runs of lines, by a suffix array over line-id sequences.

A document is a sequence of line ids (hashes of its lines that hold a word; blank lines count for
nothing).  A line is deleted when it lies in a run of consecutive lines of one document that has
at least ``min_words`` words together and that also occurs at an earlier place; places are ordered
by (doc_id, line number).  This deletes exactly the later copies of all maximal repeated runs of
at least that many words.

1. Places.  Only lines that occur twice can be in a repeated run, and only stretches of such lines
   with ``min_words`` words together can hold one.  The places of these stretches are the text.
2. Suffix array.  Distributed prefix doubling: the rank of 2k lines at a place is the rank of the
   pair (rank of k lines there, rank k lines on).  Each round the distinct pairs are sorted over
   all partitions; a pair's number in that order is its rank, and places fetch it by a join.  A
   line that a third of all documents hold is one pair, and Spark splits its join.  Rounds end
   when the ranks cover the longest window (below), which has ``min_words`` lines at most.
3. Longest common prefixes.  Each different suffix is compared with its predecessor in the array.
   The array stays in the ranges that sorted it; only one row per range crosses their borders.
4. Intervals.  The suffixes that share their first m lines are the interval of the array around
   them whose prefixes are at least m; it is named by its first suffix, the last one at or before
   a suffix whose prefix is shorter than m: a running maximum, again by ranges.
5. Runs.  For each place two windows matter: the shortest run of ``min_words`` words that starts
   there and the shortest that ends there; where two lines in turn are such windows alone, the two
   together are a third.  Every maximal repeated run, blank lines inside it included, is the union
   of such windows.  A window's interval has all its copies: those after the first are deleted.

Defined results: null, empty or blank texts have no lines and keep their text; rows repeated in
full (same doc_id and text) are copies, ordered by row within equal doc_ids by a hash of the text,
and rows equal in both are treated alike, so neither removes the other; null doc_id sorts first;
columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: A stretch: lines of one text, each of which occurs twice, without a gap.
_STRETCH = ("doc_id", "t", "g")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), i (place among the lines with words, from 1), pos (line number), n (words), a, b (the line's id)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    numbered = F.transform(F.split(text, "\n"), lambda x, k: F.struct(k.alias("pos"), x.alias("line")))
    full = F.filter(numbered, lambda x: F.btrim(x["line"], F.lit(common.WS_CHARS)) != "")
    d = docs.select("doc_id", F.xxhash64(text).alias("t"), F.posexplode(full).alias("i", "x"))
    return d.select(
        "doc_id", "t", (F.col("i") + 1).alias("i"), "x.pos", common.n_words(F.col("x.line")).alias("n"),
        F.xxhash64("x.line").alias("a"), F.xxhash64(F.lit(7), "x.line").alias("b"))


def places(lines: DataFrame, min_words: int) -> DataFrame:
    """q (number of the place), doc_id, t, g (stretch), i, pos, n, a, b: the lines of stretches that can hold a repeated run."""
    twice = common.materialize(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "twice")
    repeated = common.materialize(lines.join(twice.hint("merge"), ["a", "b"], "left_semi"), "repeated")
    g = F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("i"))
    long = F.sum("n").over(Window.partitionBy("doc_id", "t", "g"))
    kept = repeated.withColumn("g", g).withColumn("words", long).where(F.col("words") >= min_words).drop("words")
    return common.materialize(kept.withColumn("q", F.monotonically_increasing_id()), "places")


def windows(text: DataFrame, min_words: int) -> DataFrame:
    """q, doc_id, t, m (lines), start, stop (line numbers): the shortest runs of min_words words that begin or end at each place."""
    summed = text.withColumn("p", F.sum("n").over(Window.partitionBy(*_STRETCH).orderBy("i")))
    df = summed.groupBy(*_STRETCH).agg(F.array_sort(F.collect_list(F.struct("i", "q", "pos", "n", "p"))).alias("s"))
    at = lambda j: F.element_at(F.col("s"), j.cast("int"))
    size = F.size("s")
    total = lambda j, e: at(e)["p"] - at(j)["p"] + at(j)["n"]
    ahead = lambda j: F.filter(F.sequence(j, F.least(j + (min_words - 1), size)), lambda e: total(j, e) >= min_words)
    back = lambda e: F.filter(F.sequence(F.greatest(e - (min_words - 1), F.lit(1)), e), lambda j: total(j, e) >= min_words)
    every = F.sequence(F.lit(1), size)
    forward = F.transform(every, lambda j: F.struct(j.alias("j"), F.try_element_at(ahead(j), F.lit(1)).alias("e")))
    backward = F.transform(every, lambda e: F.struct(F.try_element_at(back(e), F.lit(-1)).alias("j"), e.alias("e")))
    # two lines that are windows each: the blank lines between them belong to a run that holds both
    neighbours = F.transform(every, lambda j: F.struct(j.alias("j"), F.when((j < size) & (at(j)["n"] >= min_words) & (at(F.least(j + 1, size))["n"] >= min_words), j + 1).alias("e")))
    found = F.filter(F.array_distinct(F.concat(forward, backward, neighbours)), lambda x: x["j"].isNotNull() & x["e"].isNotNull())
    df = df.withColumn("w", found).select("doc_id", "t", "s", F.explode("w").alias("x"))
    first, last = at(F.col("x.j")), at(F.col("x.e"))
    return df.select(first["q"].alias("q"), "doc_id", "t", (F.col("x.e") - F.col("x.j") + 1).cast("int").alias("m"), first["pos"].alias("start"), last["pos"].alias("stop"))


def _ranked(keys: DataFrame, *order: str) -> DataFrame:
    """keys, which differ, with ``number``: it ascends in their order, and its upper bits are the range that sorted it."""
    return common.materialize(keys.orderBy(*order).withColumn("number", F.monotonically_increasing_id() + 1), "ranks")


def _range(number):
    return F.shiftright(number - 1, 33)


def suffix_ranks(text: DataFrame, depth: int) -> DataFrame:
    """q, the stretch, i, line (rank of the line), rank (of the suffix that starts there, by its first ``depth`` lines or more)."""
    seq = Window.partitionBy(*_STRETCH).orderBy("i")
    ids = _ranked(text.select("a", "b").distinct(), "a", "b")
    now = text.join(ids.hint("merge"), ["a", "b"]).select("q", *_STRETCH, "i", F.col("number").alias("line"), F.col("number").alias("rank"))
    step = 1
    while step < depth:
        now = common.materialize(now.withColumn("next", F.coalesce(F.lead("rank", step).over(seq), F.lit(0))), "pairs")
        ranks = _ranked(now.select("rank", "next").distinct(), "rank", "next")
        now = now.join(ranks.hint("merge"), ["rank", "next"]).select("q", *_STRETCH, "i", "line", F.col("number").alias("rank"))
        step *= 2
    return common.materialize(now, "suffixes")


def prefixes(suffixes: DataFrame, depth: int) -> DataFrame:
    """rank, lcp: the suffix array without its ties, with the lines (depth at most) that each shares with the one before."""
    least = suffixes.groupBy("rank").agg(F.min("q").alias("q"))
    head = F.collect_list("line").over(Window.partitionBy(*_STRETCH).orderBy("i").rowsBetween(0, depth - 1))
    array = suffixes.select("q", head.alias("head")).join(least, "q").select("rank", _range(F.col("rank")).alias("range"), "head")
    array = common.materialize(array, "suffix-array")
    ends = array.groupBy("range").agg(F.max_by("head", "rank").alias("end"))
    # one row per range
    before = ends.select("range", F.lag("end").over(Window.orderBy("range")).alias("before"))
    own = F.lag("head").over(Window.partitionBy("range").orderBy("rank"))
    both = array.withColumn("own", own).join(before, "range").withColumn("other", F.coalesce("own", "before"))
    differ = F.array_position(F.zip_with("head", "other", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    lcp = F.when(F.col("other").isNull(), 0).when(differ == 0, depth).otherwise(differ - 1)
    return common.materialize(both.select("rank", "range", lcp.cast("int").alias("lcp")), "lcp")


def intervals(array: DataFrame, depth: int) -> DataFrame:
    """rank, first: array whose m-th entry names the interval of the suffix whose members share m lines, by its first rank."""
    names = [f"f{m}" for m in range(1, depth + 1)]
    edge = [F.when(F.col("lcp") < m, F.col("rank")) for m in range(1, depth + 1)]
    last = array.groupBy("range").agg(*[F.max(e).alias(n) for e, n in zip(edge, names)])
    # one row per range
    till = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("range", F.array(*[F.max(n).over(till) for n in names]).alias("before"))
    here = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = array.select("rank", "range", F.array(*[F.max(e).over(here) for e in edge]).alias("own"))
    return own.join(before, "range").select("rank", F.zip_with("own", "before", lambda x, y: F.coalesce(x, y)).alias("first"))


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, t, gone (array of the line numbers to delete), for documents that lose any."""
    text = places(common.materialize(_lines(docs).distinct(), "lines"), min_words)
    runs = common.materialize(windows(text, min_words), "windows")
    depth = runs.agg(F.max("m")).first()[0] or 1  # min_words at most: each line has a word
    suffixes = suffix_ranks(text, depth)
    named = common.materialize(intervals(prefixes(suffixes, depth), depth), "intervals")
    ranked = runs.join(suffixes.select("q", "rank"), "q")
    copies = ranked.join(named.hint("merge"), "rank").select("doc_id", "t", "start", "stop", "m", F.element_at("first", F.col("m")).alias("interval"))
    copies = common.materialize(copies, "copies")
    place = F.struct("doc_id", "t", "start")
    first = copies.groupBy("m", "interval").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    later = copies.join(common.materialize(first, "firsts").hint("merge"), ["m", "interval"]).where(place > F.col("first"))
    spans = common.materialize(later.select("doc_id", "t", "start", "stop"), "later").groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["stop"]))))
    return spans.select("doc_id", "t", gone.alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """docs with later copies of repeated runs deleted from text; with report, n_lines and n_removed as well."""
    gone = removals(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), "gone")
    keyed = common.carried(docs, id=F.col("doc_id"), t=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    # a null id joins through eqNullSafe; both keys are hashed, so copies of one text spread by id
    both = keyed.join(gone, F.col("id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left")
    split = both.withColumn("lines", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    out = split.withColumn("left", F.when(F.col("gone").isNotNull(), F.transform(keep, lambda i: F.get(F.col("lines"), i))))
    kept = F.when(F.col("gone").isNotNull(), F.array_join("left", "\n")).otherwise(F.col("row.text"))
    own = [kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    count = lambda c: F.size(F.filter(c, lambda x: F.btrim(x, F.lit(common.WS_CHARS)) != "")).cast("long")
    more = [count("lines").alias("n_lines"), F.when(F.col("gone").isNotNull(), count("lines") - count("left")).otherwise(F.lit(0)).cast("long").alias("n_removed")]
    return out.select(*own, *(more if report else []))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.read(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    kept = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("n_chars"), F.md5(kept).alias("kept_md5"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, pos - 1 AS pos, ls[pos] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS pos FROM d)),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l0) WHERE n > 0),
a AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM l GROUP BY doc_id),
e AS (SELECT x.doc_id, x.i AS j, x.pos AS s, y.i AS e, y.pos AS z FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i AND x.i + {MIN_WORDS - 1} AND y.p - x.p + x.n >= {MIN_WORDS}),
w AS (SELECT doc_id, j, min(s) AS s, min(e) AS e, min(z) AS z FROM e GROUP BY doc_id, j UNION SELECT doc_id, max(j), max(s), e, max(z) FROM e GROUP BY doc_id, e
  UNION SELECT x.doc_id, x.i, x.pos, y.i, y.pos FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.i = x.i + 1 AND x.n >= {MIN_WORDS} AND y.n >= {MIN_WORDS}),
g AS (SELECT w.*, md5(array_to_string(ls[j:e], chr(10))) AS h FROM w JOIN a USING (doc_id)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM g) WHERE r > 1),
x AS (SELECT DISTINCT b.doc_id, l0.pos FROM b JOIN l0 ON l0.doc_id = b.doc_id AND l0.pos BETWEEN b.s AND b.z),
k AS (SELECT l0.doc_id, string_agg(line, chr(10) ORDER BY l0.pos) FILTER (x.pos IS NULL) AS kept,
  count(*) FILTER (x.pos IS NOT NULL AND regexp_matches(line, '[^\x20\x09-\x0D]'))::BIGINT AS n_removed,
  count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]'))::BIGINT AS n_lines FROM l0 LEFT JOIN x ON x.doc_id = l0.doc_id AND x.pos = l0.pos GROUP BY l0.doc_id)
SELECT doc_id, n_lines, n_removed, length(coalesce(kept, ''))::BIGINT AS n_chars, md5(coalesce(kept, '')) AS kept_md5 FROM k
"""
