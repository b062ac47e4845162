"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

Every id is replaced by its frequency rank over the whole corpus and written in 1 to 4 bytes; the
lengths go, two bits per id, into separate control bytes (four ids each), so the decoder learns the
layout of four ids by one look-up in a table and gathers all bytes of a document with numpy.

The file format is a folder of shards: ``shards/`` has one row per document (shard, doc_id, n,
offset inside the shard, control bytes, data bytes), range-partitioned and sorted by doc_id;
``ranks/`` has the id of every rank.  Shards are written by Spark's own writer, so a task that is
run again replaces its shard.  A document's start among all ids is the total of the shards before
its own plus its offset.

Where the tokenizer's file states the splitting rule of ``_SPLIT``, encoding is memoised by piece: white space is
dropped, so a text's ids are those of its pieces in order.  Texts for which that could differ (letters that combine
or whose lower case depends on their neighbours, rare scripts, a special token's own text) and all texts of other
tokenizers are encoded whole by the library.

Defined results: null and empty texts are the end id alone; null doc_id sorts first; rows that
share a doc_id are ordered by a hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .shingles import mix, powers

END_ID = 1
#: Bounds of the memo: beyond the first, all but the pieces learned first are forgotten.
CACHE_PIECES, KEPT_PIECES, SLOTS = 600_000, 400_000, 1 << 21
#: Longer pieces are not memoised: their texts go through the tokenizer whole.
LONGEST_PIECE = 64
#: Rows that become one slice, and characters that go through the encoder at once.
SLICE, CHUNK_CHARS = 500, 400_000

#: The normaliser and the pre-tokenizer, as the tokenizer's own file states them, for which a text's
#: ids are those of its pieces one after another.  Any other tokenizer encodes whole texts itself.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

_BLANK, _LETTER, _NUMBER, _SIGN, _OTHER = range(5)


def _kinds() -> np.ndarray:
    """Kind of each code point of the scripts without combining marks; the last entry is for all others."""
    out = np.full(0x531, _OTHER, np.uint8)
    for c in (*range(0x300), *range(0x400, 0x530)):
        out[c] = {"L": _LETTER, "N": _NUMBER, "P": _SIGN, "S": _SIGN}.get(unicodedata.category(chr(c))[0], _OTHER)
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    return out


_KIND = _kinds()
_VALUE = np.random.default_rng(49).integers(1, 2**63, len(_KIND), dtype=np.uint64)


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte: itself if it can be seen, else one from 256 up."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pieces: runs of letters, single numbers, runs of signs, and the endings 's 't 're 've 'm 'll 'd."""
    n = len(code)
    start = (kind != _BLANK) & ((kind != np.concatenate(([_BLANK], kind[:-1]))) | (kind == _NUMBER))
    at = np.flatnonzero(start & (code == ord("'")))
    if len(at):
        near = np.concatenate((code, np.zeros(3, code.dtype)))
        one, two = near[at + 1], near[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        at, size = at[short | long], np.where(short, 1, 2)[short | long]
        start[at + 1] = False
        after = at + 1 + size
        inside = after[after < n]
        start[inside] |= kind[inside] == _LETTER
    edge = np.flatnonzero(start | (kind == _BLANK))
    real = start[edge]
    return edge[real], np.append(edge[1:], n)[real]


class Encoder:
    """Ids of texts, exactly those of the tokenizer without special tokens.

    Pieces are looked up by a 64-bit hash in an open table of numpy arrays; only pieces that are new go to the
    model.  Texts with code points outside the table of kinds or with very long pieces are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_piece = said["normalizer"] == _NORMALIZER and said["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and not said["model"].get("dropout")
        del said
        #: An added token's own text is one id wherever it stands.
        self.special = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.key = np.zeros(SLOTS, np.uint64)
        self.slot = np.zeros(SLOTS, np.int32)
        self.hash = np.zeros(1 << 16, np.uint64)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.known = self.used = 0

    def _place(self, h: np.ndarray, which: np.ndarray) -> None:
        """Puts different new keys into the table; of those that want one slot, one gets it and the others go on."""
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.key[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[at[won]], self.slot[at[won]] = h[won], which[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, which, at = h[rest], which[rest], (at[rest] + 1) & (SLOTS - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for unknown ones."""
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        found = self.key[at]
        out = np.where(found == h, self.slot[at], np.int32(-1))
        open_ = np.flatnonzero((found != h) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
            found = self.key[at[open_]]
            hit = found == h[open_]
            out[open_[hit]] = self.slot[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def _shrink(self) -> None:
        """Forgets all but the pieces that came first: those are the frequent ones."""
        self.known, self.used = KEPT_PIECES, int(self.start[KEPT_PIECES])
        self.key[:] = 0
        self._place(self.hash[: self.known], np.arange(self.known, dtype=np.int32))

    def _learn(self, new: list[str], h: np.ndarray) -> None:
        ids: list[int] = []
        counts = []
        for w in new:
            before = len(ids)
            signs = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_SIGNS)
            ids += [t.id for t in self.model.tokenize(signs)]
            counts.append(len(ids) - before)
        n, m, c = self.known, len(ids), np.array(counts, np.int64)
        while n + len(new) > len(self.start):
            self.hash, self.start, self.count = (np.resize(x, 2 * len(x)) for x in (self.hash, self.start, self.count))
        while self.used + m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.hash[n : n + len(new)] = h
        self.start[n : n + len(new)] = self.used + np.cumsum(c) - c
        self.count[n : n + len(new)] = c
        self.flat[self.used : self.used + m] = ids
        self._place(h, np.arange(n, n + len(new), dtype=np.int32))
        self.known, self.used = n + len(new), self.used + m

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_many(self, texts) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        if not self.by_piece:
            return [self._whole(t) for t in texts]
        low = [t.lower() for t in texts]
        joined = "\n".join(low)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        code = np.minimum(code, len(_KIND) - 1)
        kind = _KIND[code]
        first = np.cumsum([0] + [len(x) + 1 for x in low])
        other = np.zeros(len(texts), bool)
        other[np.searchsorted(first, np.flatnonzero(kind == _OTHER), "right") - 1] = True
        if "<|" in joined:
            other |= np.array([any(s in x for s in self.special) for x in low], bool)
        while True:
            for i in np.flatnonzero(other):
                kind[first[i] : first[i + 1] - 1] = _BLANK
            start, end = pieces(code, kind)
            long = start[end - start > LONGEST_PIECE]
            if not len(long):
                break
            other[np.searchsorted(first, long, "right") - 1] = True
        if self.known > CACHE_PIECES:
            self._shrink()
        power, inverse = powers(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_VALUE[code] * power[: len(code)], out=total[1:])
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)) | np.uint64(1)
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, where = np.unique(h[new], return_index=True)
            order = np.argsort(where)  # as they come in the text: the first are the frequent ones
            where = new[where[order]]
            self._learn([joined[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())], keys[order])
            at[new] = self._find(h[new])
        count = self.count[at]
        stop = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[at] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        cuts = np.concatenate(([0], stop))[np.searchsorted(start, first)]
        return [self._whole(t) if o else ids[a:b] for t, o, a, b in zip(texts, other, cuts[:-1], cuts[1:])]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    r = ranks.astype(np.uint32)
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros((len(r) + 3) // 4 * 4, np.uint8)
    codes[: len(r)] = extra
    q = codes.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    wide = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), wide[np.arange(4) <= extra[:, None]].tobytes()


#: Of each control byte, the lengths of its four numbers.
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    b = np.frombuffer(data, np.uint8)
    start = np.cumsum(lengths) - lengths
    out = b[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = lengths > k
        if more.any():
            out[more] |= b[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _in_chunks(enc: Encoder, texts: list):
    """(text, ids) in order; texts of about CHUNK_CHARS characters go through the encoder at once."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > CHUNK_CHARS:
            yield from zip(part, enc.encode_many(part))
            part, size = [], 0
    if part:
        yield from zip(part, enc.encode_many(part))


def _count(counts: np.ndarray, parts: list) -> np.ndarray:
    c = np.bincount(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    out = np.zeros(max(len(c), len(counts)), np.int64)
    out[: len(counts)] += counts
    out[: len(c)] += c
    return out


def _squeeze(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if not len(ids) or ids.max() < 65536 else "<u4").tobytes()


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes the ids of all rows of docs (doc_id, text) to ``path`` and returns it."""
    spark = docs.sparkSession
    common.small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        # small slices: only the Arrow batch itself is as large as Spark makes it
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, counts, ids_of, held = [], np.zeros(end_id + 1, np.int64), [], 0
                for t, ids in _in_chunks(enc, part.column("text").to_pylist()):
                    ids_of.append(ids)
                    held += len(ids)
                    if held > 500_000:
                        counts, ids_of, held = _count(counts, ids_of), [], 0
                    ids = np.append(ids, np.uint32(end_id))
                    rows.append((len(ids), _squeeze(ids), zlib.crc32((t or "").encode("utf-8", "surrogatepass"))))
                counts = _count(counts, ids_of)
                counts[end_id] += len(rows)
                seen = np.flatnonzero(counts)
                table = np.stack((seen, counts[seen]), axis=1).astype("<i8").tobytes()
                columns = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([table] + [None] * (len(rows) - 1), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "tie", "counts"])

    raw_path = common.shared_path(spark, "ids")
    raw = common.materialize(docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n long, ids binary, tie long, counts binary"), "ids", raw_path)

    def spread(batches):
        for pdf in batches:
            parts = [np.frombuffer(c, "<i8").reshape(-1, 2) for c in pdf["counts"]]
            if parts:
                both = np.concatenate(parts)
                seen, at = np.unique(both[:, 0], return_inverse=True)
                yield pd.DataFrame({"id": seen, "c": np.bincount(at, both[:, 1]).astype(np.int64)})

    # one row per id of the vocabulary
    freq = raw.where("counts is not null").select("counts").mapInPandas(spread, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))
    order = F.row_number().over(Window.orderBy(F.col("c").desc(), F.col("id"))) - 1
    ranks = common.materialize(freq.select("id", "c", order.cast("long").alias("rank")), "ranks", f"{path}/ranks")
    # bounded by the tokenizer's vocabulary, whatever the corpus
    pairs = ranks.select("id", "rank").toPandas().to_numpy(np.int64)
    table = np.zeros(int(pairs[:, 0].max()) + 1 if len(pairs) else 1, np.uint32)
    table[pairs[:, 0]] = pairs[:, 1]
    shared = spark.sparkContext.broadcast(table)

    def code(batches):
        rank = shared.value
        at = 0
        for pdf in batches:
            control, data, offset = [], [], []
            for n, ids in zip(pdf["n"], pdf["ids"]):
                c, d = pack(rank[np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")])
                control.append(c)
                data.append(d)
                offset.append(at)
                at += n
            yield pd.DataFrame({"shard": pdf["shard"], "doc_id": pdf["doc_id"], "n": pdf["n"], "offset": offset, "control": control, "data": data})

    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = raw.select("doc_id", "n", "ids", "tie").repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("shard", F.spark_partition_id().cast("long"))
    coded = placed.select("shard", "doc_id", "n", "ids").mapInPandas(code, f"shard long, doc_id {kind}, n long, offset long, control binary, data binary")
    coded.write.mode("overwrite").parquet(f"{path}/shards")
    common.remove(spark, raw_path)
    return path


def load(spark, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian 32-bit numbers) from the files of ``write``."""
    common.small_batches(spark)
    shards = spark.read.parquet(f"{path}/shards")
    pairs = spark.read.parquet(f"{path}/ranks").select("id", "rank").toPandas().to_numpy(np.int64)
    table = np.zeros(len(pairs) or 1, np.uint32)
    table[pairs[:, 1]] = pairs[:, 0]
    shared = spark.sparkContext.broadcast(table)
    kind = shards.schema["doc_id"].dataType.simpleString()

    def decode(batches):
        ids_of = shared.value
        for pdf in batches:
            ids = [ids_of[unpack(c, d, n)] for n, c, d in zip(pdf["n"], pdf["control"], pdf["data"])]
            yield pd.DataFrame({"shard": pdf["shard"], "doc_id": pdf["doc_id"], "offset": pdf["offset"], "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]} | ({"ids": [x.astype("<u4").tobytes() for x in ids]} if with_ids else {}))

    # one row per shard
    totals = shards.groupBy("shard").agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(F.col("shard").alias("s2"), before.alias("base"))
    out = shards.mapInPandas(decode, f"shard long, doc_id {kind}, offset long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    out = out.join(bases, F.col("shard") == F.col("s2"))
    return out.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def encode_and_load(docs: DataFrame, **options) -> DataFrame:
    """What the files say of each document, without the ids themselves."""
    spark = docs.sparkSession
    return load(spark, write(docs, common.shared_path(spark, "tokens"), **options), with_ids=False)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_and_load(common.read(spark, sf_dir, "documents"))
