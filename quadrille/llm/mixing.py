"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source the keys are range-sorted, token
counts are prefix-summed in a distributed way, and the order is cut at the source's exact budget;
whole epochs come first where the budget exceeds the source.

The prefix sum has two levels: a source's key space is split into equal ranges (the top bits of
the key; as many as the source's row count asks for), rows are summed inside their range, and the
totals of the ranges are summed per source.  No task ever holds a whole source.

Defined results: null text has size 0; null source is a source of its own, last in the order;
an empty table gives an empty result; rows repeated in full are separate rows; null doc_id is
hashed like the empty string; rows of one doc_id and size are ordered by a hash of the text;
documents of size 0 take 0 words; columns of any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_RANGE = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of sizes (src, size): src, source_size, n_rows, target.

    Water filling: sources by rising cap per weight; the first ones whose cap lies under the level
    are capped, the rest share what is left by weight.  One row per source goes through the
    ordered window, never the documents.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("src").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("over", F.col("cap") / F.col("w") <= F.col("level"))
    # the level of the first source that is not capped holds for all that follow
    free = F.min(F.when(~F.col("over"), F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("level").alias("v")))).over(everything)
    target = F.when(F.col("over"), F.col("cap")).otherwise(free["v"] * F.col("w"))
    return per.select("src", "source_size", "n_rows", target.alias("target"))


def plan_mix(docs: DataFrame, seed: str = "mix", keep: list[str] | None = None, **options) -> DataFrame:
    """One row per row of docs (text, source, doc_id needed): ``row``, a struct of its columns (or of those in keep), and

    src, size, source_size, target, epochs (whole copies), cut (words of one further, partial
    copy: only the document at the budget's edge has one) and taken (words in all).
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row")
    base = docs.select(row, F.col("source").alias("src"), F.col("doc_id").alias("id"), common.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), key.alias("key"))
    if keep and "text" not in keep:
        base = common.materialize(base, "sizes")
        slim = base.select("src", "size", "key")
    else:
        slim = common.materialize(base.select("src", "size", "key"), "sizes")
    per = targets(slim, **options)
    per = (
        per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
        .withColumn("parts", F.ceil(F.col("n_rows") / F.lit(ROWS_PER_RANGE)).cast("long"))
    )
    per = common.materialize(per.withColumnRenamed("src", "s2"), "sources")
    # one row per source: joined by hash, replicated only if Spark's own size check allows it
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("parts") / F.lit(4294967296.0)).cast("long")
    place = lambda d: d.join(per, F.col("src").eqNullSafe(F.col("s2"))).drop("s2").withColumn("part", part)
    ranges = place(slim).groupBy("src", "part").agg(F.sum("size").alias("sum"))
    start = F.coalesce(F.sum("sum").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("src").alias("s2"), F.col("part").alias("p2"), start.alias("start"))
    inside = Window.partitionBy("src", "part").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = place(base).withColumn("cum", F.sum("size").over(inside))
    summed = summed.join(ranges, F.col("src").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    before = F.col("start") + F.col("cum") - F.col("size")
    cut = F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("size")).cast("long")
    all_of_it = cut == F.col("size")
    return summed.select(
        "row", "src", "size", "source_size", "target",
        (F.col("whole") + F.when(all_of_it & (F.col("size") > 0), 1).otherwise(0)).alias("epochs"),
        F.when(all_of_it, F.lit(0)).otherwise(cut).cast("long").alias("cut"),
        (F.col("whole") * F.col("size") + cut).alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as its source's budget takes it.

    The one document at a source's edge is cut after the last word that the budget allows; its
    white space is kept as it is.  Columns are those of docs, whatever their names.
    """
    planned = plan_mix(docs, **options)
    pieces = F.regexp_extract_all("row.text", F.lit(f"[{common.WS_CLASS}]*[^{common.WS_CLASS}]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("cut").cast("int")), "")
    copies = F.concat(F.array_repeat(F.lit(False), F.col("epochs").cast("int")), F.when(F.col("cut") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    out = planned.withColumn("partial", F.explode(copies)).withColumn("head", F.when(F.col("partial"), head).otherwise(F.col("row.text")))
    return out.select(*[F.col("head").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    planned = plan_mix(common.read(spark, sf_dir, "documents"), keep=["doc_id"])
    return planned.select("row.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::INT] AS w,
  source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT arg_min(lvl, cap / w) FILTER (cap / w > lvl) AS free FROM l),
t AS (SELECT source, source_size, CASE WHEN cap / w <= lvl THEN cap ELSE free * w END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS ep FROM t),
c AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.ep, floor(e.target)::BIGINT - e.ep * e.source_size AS rest,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (ep * size + least(greatest(rest - before, 0), size))::BIGINT AS taken FROM c
"""
