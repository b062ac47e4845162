"""Removal of every byte that a repeated 400-byte string covers.

Long matches are marked by a run-length index (``runlength.py``): a run-compressed Burrows-Wheeler
transform with sampled run ends, whose samples give the matching statistics of every place.  An
index is built over the text of one task, so what can match comes to one task first:

1. Anchors.  Of the 201 strings of 200 bytes inside each 400-byte string, the one with the smallest
   hash is its anchor (all of them at ties).  Equal strings have equal anchors at equal offsets, so
   only documents' anchors, about one per 100 bytes, are compared at all.
2. Contexts.  Everything a string with that anchor can reach is the 600 bytes around it.  Anchors
   that share hash and context are fully repeated: their whole context is marked.
3. Index.  Where a repeated anchor has several contexts, one of each goes to the anchor's task.
   Contexts of one document that overlap are joined there, so every byte of a document is in an
   index once, and a match with another place is a repeat.  The contexts of an anchor with more than
   ``HOT`` of them, which no task should hold, are split by where they leave one of them (``_split``)
   until every group fits a task; each group goes through an index like any other.

Defined results: null and empty texts have 0 bytes and the digest of nothing; texts under 400 bytes
keep all; rows repeated in full are copies of each other; null doc_id is a document like any other.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .runlength import RunLengthIndex
from .shingles import _BYTE, CHUNK, mix, powers

SPAN = 400
HOT = 4_000
_U = np.uint64


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w consecutive values (van Herk): len(x) - w + 1 of them."""
    n = len(x)
    pad = -n % w
    y = np.concatenate((x, np.full(pad, x[-1], x.dtype))).reshape(-1, w)
    up = f.accumulate(y, axis=1).reshape(-1)
    down = f.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(down[: n - w + 1], up[w - 1 : n])


def anchors(parts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, place, hash and context hash of each anchor; parts have span bytes at least."""
    k = span // 2
    w = span - k + 1
    b = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    p, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=total[1:])
    gram = mix((total[k:] - total[:-k]) * inverse[: len(b) - k + 1]) | _U(1)
    least = _sliding(gram, w, np.minimum)
    for e in ends[:-1]:
        least[max(e - span + 1, 0) : e] = 0  # strings that would cross into the next document
    reach = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    at = np.flatnonzero(_sliding(reach, w, np.maximum) == gram)
    doc = np.searchsorted(ends, at, side="right")
    first = (ends - [len(x) for x in parts])[doc]
    s, e = np.maximum(at - (span - k), first), np.minimum(at + span, ends[doc])
    context = mix(mix((total[e] - total[s]) * inverse[s]) + (at - s).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (e - at).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return doc, at - first, gram[at].view(np.int64), context.view(np.int64)


def _anchor_rows(docs: DataFrame, span: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            rows, part, size = [], [], 0
            for i in range(batch.num_rows + 1):
                t = texts[i].as_buffer() if i < batch.num_rows and texts[i].is_valid else None
                if t is not None and t.size >= span:
                    part.append(t.to_pybytes())
                    rows.append(i)
                    size += t.size
                if part and (size > CHUNK or i == batch.num_rows):
                    doc, at, h, c = anchors(part, span)
                    take = pa.array(np.array(rows)[doc])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(at.astype(np.int32)), pa.array(h), pa.array(c)], ["doc_id", "th", "pos", "h", "c"])
                    rows, part, size = [], [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th long, pos int, h long, c long")


def _contexts(docs: DataFrame, span: int) -> DataFrame:
    """docs: doc_id, th, text, at (array of pos, h).  The bytes around each anchor."""
    k = span // 2

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("h", "doc_id", "th", "pos", "left", "ctx")}
            ids, ths = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            for i, places in enumerate(batch.column("at").to_pylist()):
                t = batch.column("text")[i].as_buffer().to_pybytes()
                for x in places:
                    s = max(x["pos"] - (span - k), 0)
                    for n, v in zip(out, (x["h"], ids[i], ths[i], x["pos"], x["pos"] - s, t[s : x["pos"] + span])):
                        out[n].append(v)
                if len(out["h"]) >= 5000:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out = {n: [] for n in out}
            if out["h"]:
                yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("h", pa.int64()), ("doc_id", _arrow(docs)), ("th", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("ctx", pa.binary())])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"h long, doc_id {kind}, th long, pos int, left int, ctx binary")


def _arrow(df: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)


def _segments(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(text, row, place) of the stretches of documents that the contexts cover; those that overlap are joined."""
    codes = t.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    th = t.column("th").to_numpy()
    start = t.column("pos").to_numpy() - t.column("left").to_numpy()
    ctx = t.column("ctx").to_pylist()
    parts: list[bytearray] = []
    row, place = [], []
    now, stop = None, 0
    for i in np.lexsort((start, th, codes)):
        own, s = (codes[i], th[i]), int(start[i])
        if own != now or s > stop:
            parts.append(bytearray(ctx[i]))
            row.append(i)
            place.append(s)
            now, stop = own, s + len(ctx[i])
        elif s + len(ctx[i]) > stop:
            parts[-1] += ctx[i][stop - s :]
            stop = s + len(ctx[i])
    return [bytes(x) for x in parts], np.array(row, np.int64), np.array(place, np.int64)


def _fine(contexts: DataFrame, span: int) -> DataFrame:
    """contexts sorted by their group g inside each partition -> doc_id, th, start, stop."""
    schema = pa.schema([("doc_id", _arrow(contexts)), ("th", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def marks(t: pa.Table):
        parts, row, place = _segments(t)
        part, first, last = RunLengthIndex(parts).repeats(span)
        take = pa.array(row[part])
        start, stop = place[part] + first, place[part] + last + span
        return pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().take(take), t.column("th").combine_chunks().take(take), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], schema=schema)

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 4000:
                continue
            g = held.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1], side="left"))  # the last group may go on
            if cut:
                yield marks(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield marks(held)

    return contexts.mapInArrow(run, f"doc_id {contexts.schema['doc_id'].dataType.simpleString()}, th long, start int, stop int")


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _compared(rows: DataFrame, k: int) -> DataFrame:
    """rows: contexts with their group's reference (ref_ctx, ref_left).  What each shares with it, and the groups it goes on in.

    A row per group it goes on in, one at least; shared_left and shared_right are set on the first of them.
    """
    schema = pa.schema([("old", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("doc_id", _arrow(rows)), ("th", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("ctx", pa.binary()), ("shared_left", pa.int32()), ("shared_right", pa.int32())])

    def key(*parts) -> int:
        return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)

    def run(batches):
        for batch in batches:
            take, g, lefts, rights = [], [], [], []
            for i, (old, left, ctx, ref_left, ref) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "left", "ctx", "ref_left", "ref_ctx")))):
                if left == ref_left and ctx == ref:
                    continue
                before, after = ctx[:left][::-1], ctx[left + k :]
                x, y = _common(before, ref[:ref_left][::-1]), _common(after, ref[ref_left + k :])
                on = [key(old, side, n, part[n]) for side, n, part in ((0, x, before), (1, y, after)) if n < len(part)] or [None]
                take += [i] * len(on)
                g += on
                lefts += [x] + [None] * (len(on) - 1)
                rights += [y] + [None] * (len(on) - 1)
            t = pa.array(take, pa.int64())
            own = {c: batch.column(c).take(t) for c in ("h", "doc_id", "th", "pos", "left", "ctx")}
            yield pa.RecordBatch.from_arrays([batch.column("g").take(t), pa.array(g, pa.int64()), *own.values(), pa.array(lefts, pa.int32()), pa.array(rights, pa.int32())], schema=schema)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"old long, g long, h long, doc_id {kind}, th long, pos int, left int, ctx binary, shared_left int, shared_right int")


def _split(contexts: DataFrame, span: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(contexts in groups g of at most hot rows, ranges to remove as doc_id, th, start, stop).

    In a group that is too large each context is compared with one of them, the reference, and both
    are marked where they share a string.  Two others share a string beyond that only if they leave
    the reference at the same place with the same next byte, on the left or on the right: so they
    go on in the groups of these two places and bytes.  Groups of one context are done.  The
    reference is the one with the smallest hash: a group that goes on with over half of the contexts
    has one of its own as reference in over half of all cases, so the rounds grow with the logarithm
    of a group's size (the first in byte order would often be an outlier that splits nothing).
    """
    k = span // 2
    names = ["g", "h", "doc_id", "th", "pos", "left", "ctx"]
    now, small, found = contexts.withColumn("g", F.col("h")).select(*names), [], []
    while True:
        pick = F.struct(F.xxhash64("ctx", "left").alias("r"), "ctx", "left", "doc_id", "th", "pos")
        sizes = common.materialize(now.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min(pick).alias("ref")).where("c > 1"), "groups")
        fits = now.join(sizes.where(F.col("c") <= hot).select("g").hint("merge"), "g", "left_semi")
        small.append(common.materialize(fits, "fits") if small else fits)  # later rounds hold few rows
        large = sizes.where(F.col("c") > hot)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, found) if found else None
        refs = large.select("g", F.col("ref.ctx").alias("ref_ctx"), F.col("ref.left").alias("ref_left"))
        out = common.materialize(_compared(now.join(refs, "g").select(*names, "ref_ctx", "ref_left"), k), "compared")
        match = out.where(F.col("shared_left") + F.col("shared_right") >= span - k)
        marked = match.select("doc_id", "th", (F.col("pos") - F.col("shared_left")).alias("start"), (F.col("pos") + k + F.col("shared_right")).alias("stop"))
        most = match.groupBy(F.col("old").alias("g")).agg(F.max("shared_left").alias("l"), F.max("shared_right").alias("r"))
        own = large.join(most, "g").select("ref.doc_id", "ref.th", (F.col("ref.pos") - F.col("l")).alias("start"), (F.col("ref.pos") + k + F.col("r")).alias("stop"))
        found.append(common.materialize(marked.unionByName(own), "marked"))
        now = out.where("g is not null").select(*names)


def spans(docs: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """doc_id, th, start, stop: byte ranges to remove, overlapping, not clipped.  docs: doc_id, text, th."""
    reach = span - span // 2
    found = common.materialize(_anchor_rows(docs, span), "anchors")
    # counts are written first: a join of two exchanges is one that Spark can split where a key is hot
    groups = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1").drop("n")
    again = common.materialize(found.join(common.materialize(groups, "groups").hint("merge"), "h"), "repeated")
    mixed = again.where("c1 <> c2")
    classes = mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "th", "pos")).alias("rep"))
    classes = common.materialize(classes.select("h", "c", "m", "rep.*"), "contexts")
    several = common.materialize(classes.where("m > 1").select("h", "c"), "classes")
    whole = again.where("c1 = c2").select("doc_id", "th", "pos").unionByName(mixed.join(several.hint("merge"), ["h", "c"], "left_semi").select("doc_id", "th", "pos"))
    whole = whole.select("doc_id", "th", (F.col("pos") - reach).alias("start"), (F.col("pos") + span).alias("stop"))
    places = classes.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "h")).alias("at")).select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "at")
    needed = docs.join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))).select("doc_id", "th", "text", "at")
    around, ranges = _split(common.materialize(_contexts(needed, span), "around"), span, hot)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = _fine(around.repartition(parts, "g").sortWithinPartitions("g"), span)
    out = whole.unionByName(fine)
    return out.unionByName(ranges) if ranges is not None else out


def _keep(docs: DataFrame, output: bool) -> DataFrame:
    """docs: doc_id, text, cut (array of start, stop)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept"] + ["kept"] * output
    schema = pa.schema(list(zip(names, [_arrow(docs), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()])))

    def run(batches):
        for batch in batches:
            rows = []
            cuts = batch.column("cut")
            for i, t in enumerate(batch.column("text")):
                t = t.as_buffer().to_pybytes() if t.is_valid else b""
                kept, n = t, 0
                if cuts[i].is_valid:
                    c = cuts[i].values
                    a, z = np.maximum(c.field(0).to_numpy(), 0), np.minimum(c.field(1).to_numpy(), len(t))
                    order = np.argsort(a, kind="stable")
                    a, far = a[order], np.maximum.accumulate(z[order])
                    new = np.concatenate(([True], a[1:] > far[:-1]))
                    first, last = a[new], far[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))]
                    n = len(first)
                    kept = b"".join(t[x:y] for x, y in zip(np.concatenate(([0], last)), np.concatenate((first, [len(t)]))))
                rows.append((len(t), len(t) - len(kept), n, hashlib.sha256(kept).hexdigest(), len(kept), kept))
            columns = [batch.column("doc_id")] + [pa.array([r[j] for r in rows], schema.field(j + 1).type) for j in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long" + (", kept binary" if output else ""))


def dedup_substrings(docs: DataFrame, span: int = SPAN, output: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept and, with output, kept (bytes): one row per row of docs."""
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    cut = spans(docs, span, hot).distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("cut")).select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "cut")
    both = docs.join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    return _keep(both.select("doc_id", "text", "cut"), output)


def query(spark, sf_dir: str) -> DataFrame:
    """The digests, and what stays of each text: a cut may part a character, whose rest then reads as U+FFFD."""
    out = dedup_substrings(common.read(spark, sf_dir, "documents"))
    return out.withColumns({"repeats": F.col("n_removed") > 0, "kept": F.make_valid_utf8(F.col("kept").cast("string"))})
