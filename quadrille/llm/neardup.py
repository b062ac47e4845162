"""MinHash near-dedup: universal hash minima, banding, verification, components.

1. Every text becomes the set of its word shingles; documents with equal sets form a class, of
   which the smallest doc_id goes on.  A class is an aggregate, so a third of all rows in one is
   a row per task.
2. 40 bands of 5 minima put the representatives into buckets: two sets of similarity 0.8 share no
   bucket with probability (1 - 0.8^5)^40 = 1e-7.
3. A bucket never becomes all its pairs.  In the first round each member meets the bucket's
   most met member: the one whose buckets hold the most rows, which in a group of copies is the
   text they were made from.  Links found join labels; then only members of different labels are
   still open.  Each open document has a centre, the most met pivot of its buckets, and is written
   as its difference from it: with i shingles in the centre and the extra ones outside, two
   documents of one centre can be linked only if they share at least
   80/180 * (n + n') - min(i, i') extra shingles (what many of them share counts as the centre's).  So those pairs come from an index of extra
   shingles, which are mostly a document's own, and not from the bucket.  Pairs that this leaves out
   or cannot judge (other centres, or a bound of zero, which both documents need 80% of their shingles
   in the centre for) meet in the bucket: each round a growing
   number of members outside the largest label, the most met first, meet members of other labels
   and leave the bucket.  There, shingles that no other open document has cannot be shared either.
4. A pair is first compared by its signatures (one byte of each of the 200 minima; a pair at the
   threshold falls below the margin with probability under 1e-7), then on the full sets:
   100 * intersection >= 80 * union.
5. Labels are components by alternating large-star and small-star.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a null
doc_id is linked with nothing, its component is null and it is kept; rows that share a doc_id are
one node with the links of all its texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import MinHash, sets

BANDS, ROWS, SIMILARITY_PCT = 40, 5, 80
FIRST_PIVOTS, GROWTH = 8, 32


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        minhash = MinHash(BANDS, ROWS)
        for pdf in batches:
            n, k1, k2, bands, sigs = [], [], [], [], []
            for s in sets(pdf["text"], width):
                n.append(len(s))
                k = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                k1.append(k[0])
                k2.append(k[1])
                sig = minhash.signature(s) if len(s) else None
                bands.append(minhash.keys(sig) if len(s) else None)
                sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": n, "k1": k1, "k2": k2, "bands": bands, "sig": sigs})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {kind}, n long, k1 long, k2 long, bands array<long>, sig binary")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "s": [s.tobytes() for s in sets(pdf["text"], width)]})

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, s binary")


def _similar_signatures(pairs: DataFrame, pct: int) -> DataFrame:
    total = BANDS * ROWS
    t = pct / 100
    margin = total * (t - 5.2 * (t * (1 - t) / total) ** 0.5)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["sx"]), np.uint8).reshape(len(pdf), -1)
                b = np.frombuffer(b"".join(pdf["sy"]), np.uint8).reshape(len(pdf), -1)
                yield pdf.loc[(a == b).sum(axis=1) >= margin, ["x", "y"]]

    return pairs.mapInPandas(run, f"x {pairs.schema['x'].dataType.simpleString()}, y {pairs.schema['y'].dataType.simpleString()}")


def _similar_sets(pairs: DataFrame, pct: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            good = []
            for a, b in zip(pdf["sx"], pdf["sy"]):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if 100 * min(len(a), len(b)) < pct * max(len(a), len(b)):
                    good.append(False)
                    continue
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= pct * (len(a) + len(b) - shared))
            yield pdf.loc[good, ["x", "y"]]

    return pairs.mapInPandas(run, f"x {pairs.schema['x'].dataType.simpleString()}, y {pairs.schema['y'].dataType.simpleString()}")


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    out = pairs
    for end in ("x", "y"):
        out = out.join(table.select(F.col("doc_id").alias(end), F.col(value).alias(f"s{end}")), end)
    return out


def _shared_counts(full: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, sn (shingles), ss (those that another of the docs has as well)."""
    def run(batches):
        for pdf in batches:
            parts = [np.frombuffer(b, np.int64) for b in pdf["s"]]
            step = 200
            for i in range(0, len(parts), step):
                p = parts[i : i + step]
                yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy()[i : i + step], [len(x) for x in p]), "h": np.concatenate(p)})

    own = full.join(docs, "doc_id", "left_semi")
    rows = own.mapInPandas(run, f"doc_id {full.schema['doc_id'].dataType.simpleString()}, h long")
    rows = common.materialize(rows, "shingles")
    several = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    shared = rows.join(several, "h", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("ss"))
    sizes = own.groupBy("doc_id").agg(F.max(F.octet_length("s") / 8).cast("long").alias("sn"), F.count(F.lit(1)).alias("texts"))
    # an id with several texts has no single set: nothing is left out for it
    return sizes.join(shared, "doc_id", "left").select("doc_id", F.when(F.col("texts") == 1, F.col("sn")).alias("sn"), F.coalesce("ss", F.lit(0)).alias("ss"))


def _differences(full: DataFrame, centres: DataFrame) -> DataFrame:
    """doc_id, centre, cn (shingles), ci (those in the centre), extra (those outside it)."""
    kind = full.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            n, i, extra = [], [], []
            for a, b in zip(pdf["s"], pdf["c"]):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                own = np.setdiff1d(a, b, assume_unique=True)
                n.append(len(a))
                i.append(len(a) - len(own))
                extra.append(own)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "centre": pdf["centre"], "cn": n, "ci": i, "extra": extra})

    single = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id")
    sets_ = full.join(single, "doc_id", "left_semi")
    both = centres.join(sets_, "doc_id").join(sets_.select(F.col("doc_id").alias("centre"), F.col("s").alias("c")), "centre")
    return both.mapInPandas(run, f"doc_id {kind}, centre {kind}, cn long, ci long, extra array<long>")


def _consensus(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, centre, cn, ci) and (doc_id, centre, e), with shingles that many documents of a centre share taken into it.

    A centre may itself be a copy with changes; what it lacks then is outside it in all others.  The
    bound holds for any set as centre, so such shingles are counted as the centre's.  The rows, one
    for each shingle outside a document's centre, are made once for the three steps that read them.
    """
    rows = common.materialize(apart.select("doc_id", "centre", F.explode("extra").alias("e")), "extra")
    size = apart.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
    shared = rows.groupBy("centre", "e").agg(F.count(F.lit(1)).alias("c")).join(size, "centre").where("c > 20 and c * 20 > n").select("centre", "e")
    shared = common.materialize(shared, "consensus")
    more = rows.join(shared, ["centre", "e"], "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("more"))
    inside = apart.drop("extra").join(more, "doc_id", "left").select("doc_id", "centre", "cn", (F.col("ci") + F.coalesce("more", F.lit(0))).alias("ci"))
    return common.materialize(inside, "inside"), common.materialize(rows.join(shared, ["centre", "e"], "left_anti"), "outside")


def link(docs: DataFrame, width: int, pct: int = SIMILARITY_PCT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    spark = docs.sparkSession
    common.small_batches(spark)
    path = common.shared_path(spark, "components")
    with common.scratch(spark, "near-dedup"):
        return common.materialize(_link(docs, width, pct), "components", path)


def _link(docs: DataFrame, width: int, pct: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    sigs = common.materialize(_signatures(docs, width), "signatures")
    classes = sigs.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = common.materialize(classes, "classes")
    reps = sigs.join(classes, ["k1", "k2"]).where(F.col("doc_id") == F.col("rep"))
    rows = reps.select("doc_id", F.explode("bands").alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("size")).where("a < b").drop("a", "b")
    members = common.materialize(rows.join(ends, "bucket"), "members")
    met = common.materialize(members.groupBy("doc_id").agg(F.sum("size").alias("met")), "met")
    wanted = met.select("doc_id")
    members = members.drop("size").join(met, "doc_id")
    pivot = members.groupBy("bucket").agg(F.max_by("doc_id", F.struct("met", F.xxhash64("doc_id"))).alias("pivot"))
    members = common.materialize(members.join(pivot, "bucket").select("bucket", "doc_id", "met", "pivot"), "pivots")
    full = common.materialize(_full_sets(docs.join(wanted, "doc_id", "left_semi"), width).distinct(), "sets")
    sig = common.materialize(sigs.where("n > 0").join(wanted, "doc_id", "left_semi").select("doc_id", "sig").distinct(), "sigs")

    def verify(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        near = common.materialize(_similar_signatures(_with(pairs, sig, "sig"), pct), "near")
        return common.materialize(_similar_sets(_with(near.distinct(), full, "s"), pct).distinct(), "links")

    # equal sets under different ids are linked through the class; ids with several texts through their classes
    pair = lambda a, b: (F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    checked = common.materialize(members.where("doc_id <> pivot").select(*pair("doc_id", "pivot")).distinct(), "checked")
    links = verify(checked)
    many = sigs.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("doc_id")
    own = sigs.join(many, "doc_id", "left_semi").join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    labels = common.materialize(components(links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(own)), "labels")
    def relabel(labels: DataFrame, found: DataFrame) -> DataFrame:
        if found.isEmpty():
            return labels
        joined = found.join(labels.select(F.col("node").alias("x"), F.col("component").alias("cx")), "x", "left").join(labels.select(F.col("node").alias("y"), F.col("component").alias("cy")), "y", "left")
        between = common.materialize(joined.select(F.coalesce("cx", "x").alias("u"), F.coalesce("cy", "y").alias("v")), "between")
        merged = components(between).withColumnRenamed("component", "c2")
        known = labels.unionByName(between.select(F.col("u").alias("node"), F.col("u").alias("component"))).unionByName(between.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        known = known.groupBy("node").agg(F.min("component").alias("component"))
        return common.materialize(known.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("c2", "component").alias("component")), "labels")

    room = lambda i, n: F.col(i) * (100 + pct) - F.col(n) * pct
    need = lambda n: F.col(n) * pct
    open_rows, pivots, first = members, FIRST_PIVOTS, True
    while True:
        now = open_rows.select("bucket", "doc_id", "met", *(["pivot"] if first else ["sn", "ss", "centre", "cn", "ci"])).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        now = now.withColumn("label", F.coalesce("component", "doc_id")).drop("component")
        if first:
            now = now.where("doc_id <> pivot").drop("pivot")  # the first pivot has met all
        # x and y can be linked only if room(x) >= need(y) and room(y) >= need(x): by their shared shingles, and by those in the centre if they have one centre
        bounds = [] if first else [F.max(F.coalesce(room("ss", "sn"), F.lit(2**62))).alias("g"), F.min(F.coalesce(need("sn"), F.lit(0))).alias("m"), F.max(room("ci", "cn")).alias("f"), F.min(need("cn")).alias("k"), F.min("centre").alias("c1"), F.max("centre").alias("c2"), F.count("centre").alias("n")]
        per = common.materialize(now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), *bounds), "labels-of-buckets")
        mixed = F.lit(True) if first else (F.min("c1") < F.max("c2")) | (F.sum("n") < F.sum("c"))
        largest = per.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count(F.lit(1)).alias("labels"), mixed.alias("mixed")).where("labels > 1").drop("labels")
        if not first:  # what the members of other labels can meet at all
            others = per.join(largest.withColumnRenamed("bucket", "b"), (F.col("bucket") == F.col("b")) & (F.col("label") != F.col("largest")))
            largest = others.groupBy("bucket", "largest", "mixed").agg(F.max("g").alias("g"), F.min("m").alias("m"), F.max("f").alias("f"), F.min("k").alias("k"))
        left_open = now.join(largest, "bucket")
        if not first:
            meets = F.col("sn").isNull() | ((need("sn") <= F.col("g")) & (room("ss", "sn") >= F.col("m")))
            near = F.col("mixed") | ((need("cn") <= F.col("f")) & (room("ci", "cn") >= F.col("k")))
            alone = F.col("mixed") | (F.col("ci") * 100 >= F.col("cn") * pct)
            left_open = left_open.where(alone & ((F.col("label") != F.col("largest")) | (meets & near)))
        open_rows = common.materialize(left_open.drop("mixed", "g", "m", "f", "k"), "open")
        if first and not open_rows.isEmpty():
            counts = common.materialize(_shared_counts(full, open_rows.select("doc_id").distinct()), "shared")
            centre = members.join(met.select(F.col("doc_id").alias("pivot"), F.col("met").alias("pm")), "pivot").groupBy("doc_id").agg(F.max_by("pivot", F.struct("pm", F.xxhash64("pivot"))).alias("centre"))
            centre = centre.join(counts.select("doc_id"), "doc_id", "left_semi")
            apart, outside = _consensus(common.materialize(_differences(full, centre), "differences"))
            named = open_rows.select("doc_id", "label").distinct()
            posts = outside.join(apart, ["doc_id", "centre"]).join(named, "doc_id").select("doc_id", "label", "centre", "cn", "ci", "e")
            left, right = posts.alias("a"), posts.select("centre", "e", F.col("doc_id").alias("y"), F.col("label").alias("ly"), F.col("cn").alias("yn"), F.col("ci").alias("yi"))
            same = left.join(right, ["centre", "e"]).where("doc_id > y and label <> ly").groupBy(F.col("doc_id").alias("x"), "y").agg(F.count(F.lit(1)).alias("c"), F.first("cn").alias("cn"), F.first("yn").alias("yn"), F.first(F.least("ci", "yi")).alias("i"))
            pairs = same.where((F.col("c") + F.col("i")) * (100 + pct) >= (F.col("cn") + F.col("yn")) * pct).select("x", "y")
            pairs = common.materialize(pairs.join(checked, ["x", "y"], "left_anti"), "extra-pairs")
            checked = checked.unionByName(pairs)
            labels = relabel(labels, verify(pairs))
            open_rows = open_rows.join(counts, "doc_id").join(apart, "doc_id", "left").where(F.col("sn").isNull() | (F.col("ss") * 100 >= F.col("sn") * pct))
            first = False
            continue
        first = False
        if open_rows.isEmpty():
            break
        order = Window.partitionBy("bucket").orderBy(F.desc("met"), F.xxhash64("doc_id"), "doc_id")
        chosen = open_rows.where("label <> largest").withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots).select("bucket", F.col("doc_id").alias("y"), F.col("label").alias("ly"), F.col("sn").alias("yn"), F.col("ss").alias("ys"), F.col("centre").alias("yc"), F.col("cn").alias("ycn"), F.col("ci").alias("yci"))
        chosen = common.materialize(chosen, "pivots")
        reach = lambda shared, n, m: shared * (100 + pct) >= (n + m) * pct
        alike = F.col("centre").eqNullSafe(F.col("yc")) & F.col("centre").isNotNull()
        apart_ok = F.when(alike, reach(F.least("ci", "yci"), F.col("cn"), F.col("ycn"))).otherwise(F.lit(True))
        possible = F.col("sn").isNull() | F.col("yn").isNull() | (reach(F.least("ss", "ys"), F.col("sn"), F.col("yn")) & apart_ok)
        pairs = open_rows.join(chosen, (open_rows["bucket"] == chosen["bucket"]) & (F.col("label") != F.col("ly")) & possible).select(*pair("doc_id", "y")).distinct()
        pairs = common.materialize(pairs.join(checked, ["x", "y"], "left_anti"), "pairs")
        checked = checked.unionByName(pairs)
        labels = relabel(labels, verify(pairs))
        done = chosen.select("bucket", F.col("y").alias("doc_id"))
        open_rows = open_rows.join(done, ["bucket", "doc_id"], "left_anti")
        pivots *= GROWTH
    classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(classes, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, pct: int = SIMILARITY_PCT) -> DataFrame:
    """One document of each group of near copies (its smallest doc_id), all columns of docs.

    Of rows that share the doc_id that stays, one row stays.  Rows without doc_id all stay.
    """
    lost = link(docs, width, pct).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("__c"))
    lost = common.materialize(lost.where(~F.col("kept") | (F.col("__c") > 1)).select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept")), "lost")
    whole = docs.join(lost, F.col("doc_id") == F.col("__id"), "left")
    # rows of a kept id that occurs more than once: the first by text stays
    row = F.row_number().over(Window.partitionBy("__id").orderBy("text"))
    once = whole.where("__id is null").select(*docs.columns)
    again = whole.where("__kept").withColumn("__r", row).where("__r = 1").select(*docs.columns)
    return once.unionByName(again) if not lost.where("__kept").isEmpty() else once


def query(spark, sf_dir: str) -> DataFrame:
    return link(common.read(spark, sf_dir, "documents"), 2)
