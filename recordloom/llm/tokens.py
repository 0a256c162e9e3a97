"""Training-order materialisation of token ids as fixed-stride binary shards.

Documents are tokenised and cut into sequences of `length` ids, an end mark after each
document and padding after the last of its sequences. Sequence number s (documents in
keyed order, their sequences in a row) goes to global slot pi(s), pi a Feistel
permutation with cycle walking. Shard k holds slots [k * per_shard, (k + 1) * per_shard)
as records of one size, so slot x is at byte (x mod per_shard) * stride of shard x div
per_shard: reading in training order is sequential and can resume at any slot.

A record is the document's id (8 bytes; NO_ID for null), the sequence's number in it
(4 bytes), its ids in use (4 bytes), and `length` ids of 2 or 4 bytes, little-endian.

Ids are kept once as a compressed table in the shared folder, since slots need all
counts first. Slots are then written in `waves`, each a range of slots with a range
shuffle of its own, whose files go when its execution ends: disk holds the table, the
shards and one wave. A file is written under a name of its own and renamed by the task
that filled it, so a task that is lost and run again leaves whole shards only.

Defined cases: a null or empty text is one sequence that holds the end mark; a very long
text has as many sequences as it needs; repeated rows have sequences each; an empty table writes no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, bucket_of, put_in_place, remove, row_key, scratch, text_or_empty, tidy_shuffles
from .secrets import encoder, shipped
from .sharding import Feistel

LENGTH = 512
KEY = 31
#: Least size of a shard; they grow with the data, so that there are `MOST_SHARDS` at most.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 16_384
WAVES = 4
NO_ID = -(1 << 63)
END = 50256  # free in the vocabularies of 50,256 ranks


def dtype_of(ids: int) -> np.dtype:
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


def record_type(length: int, ids: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("used", "<i4"), ("ids", dtype_of(ids), (length,))])


def tokenised(docs: DataFrame, vocabulary: str, length: int, end: int, buckets: int) -> DataFrame:
    """bucket, key, doc_id, parts, ids (bytes without padding) for each document."""
    kind, ranks = dtype_of(end + 1), shipped(docs.sparkSession, vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks.value)
        for b in it:
            texts, at = b.column("text"), 0
            while at < len(texts):  # a few documents at a time, so batches of long ones stay small
                n, size = 0, 0
                out, parts = [], []
                while at + n < len(texts) and (not n or size < 8 << 20):
                    ids = np.array(enc.encode_ordinary(texts[at + n].as_py()) + [end], kind)
                    out.append(ids.tobytes())
                    parts.append(-(-len(ids) // length))
                    size += len(out[-1])
                    n += 1
                yield pa.RecordBatch.from_arrays(
                    [b.column("bucket").slice(at, n), b.column("key").slice(at, n), b.column("doc_id").slice(at, n), pa.array(parts, pa.int64()), pa.array(out, pa.binary())],
                    names=["bucket", "key", "doc_id", "parts", "ids"],
                )
                at += n

    text = text_or_empty()
    rows = docs.select(row_key(F.col("doc_id"), F.md5(text.cast("binary"))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(bucket_of(F.col("key"), buckets).alias("bucket"), "key", "doc_id", "text")
    return rows.mapInArrow(batches, "bucket int, key string, doc_id long, parts long, ids binary")


def write_shards(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    length: int = LENGTH,
    end: int = END,
    key: int = KEY,
    shard_bytes: int = SHARD_BYTES,
    buckets: int | None = None,
    waves: int = WAVES,
) -> DataFrame:
    """Write the shards and their manifest; one row for each shard: shard, path, sequences, first_slot, bytes, sha256."""
    spark = docs.sparkSession
    buckets = buckets or bucket_count(docs.count())
    along = Window.partitionBy("bucket").orderBy("key", "doc_id", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokenised(docs, vocabulary, length, end, buckets).withColumn("inner", F.coalesce(F.sum("parts").over(along), F.lit(0)))
    held = scratch(spark, "tokens")
    with tidy_shuffles(spark):
        placed.drop("key").write.option("compression", "zstd").parquet(held)
    table = spark.read.parquet(held)
    totals = table.groupBy("bucket").agg(F.sum("parts").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("bucket", F.coalesce(before, F.lit(0)).alias("start"), "n").collect()  # one row for BUCKET_ROWS documents
    total = sum(r["n"] for r in starts)
    start_of = spark.sparkContext.broadcast({r["bucket"]: r["start"] for r in starts})
    rtype = record_type(length, end + 1)
    stride = rtype.itemsize
    per_shard = max(1, min(shard_bytes // stride, total or 1), -(-total // MOST_SHARDS))
    shards = -(-total // per_shard)

    def cutter(low: int, high: int):
        """Records of the slots from low up to high."""

        def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pi, block = Feistel(total, key), max(1, (4 << 20) // stride)
            slots, data = [], []

            def batch():
                slot = np.array(slots, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), pa.array(data, pa.binary())], names=["shard", "slot", "record"])

            for b in it:
                parts = b.column("parts").to_numpy()
                first = np.array([start_of.value[k] for k in b.column("bucket").to_pylist()], np.int64) + b.column("inner").to_numpy()
                ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
                row = np.repeat(np.arange(len(parts)), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                slot = pi.forward(first[row] + part)
                mine = np.flatnonzero((slot >= low) & (slot < high))
                tokens, of = None, -1
                for k in mine:
                    if row[k] != of:
                        of = row[k]
                        tokens = np.frombuffer(b.column("ids")[int(of)].as_buffer(), rtype["ids"].base)
                    piece = tokens[part[k] * length : (part[k] + 1) * length]
                    rec = np.zeros((), rtype)
                    rec["doc_id"], rec["part"], rec["used"] = ids[of], part[k], len(piece)
                    rec["ids"] = end
                    rec["ids"][: len(piece)] = piece
                    slots.append(slot[k])
                    data.append(rec.tobytes())
                    if len(data) >= block:
                        yield batch()
                        slots, data = [], []
            if data:
                yield batch()

        return cut

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        done = {c: [] for c in ("shard", "path", "sequences", "first_slot", "bytes", "sha256")}
        shard, out, tmp, n, sha = None, None, "", 0, None

        def close():
            out.close()
            name = f"shard-{shard:06d}.bin"
            put_in_place(fs, tmp, f"{path}/{name}")
            for c, v in zip(done, (shard, name, n, shard * per_shard, n * stride, sha.hexdigest())):
                done[c].append(v)

        for b in it:
            for k, slot, rec in zip(b.column("shard").to_pylist(), b.column("slot").to_pylist(), b.column("record")):
                if k != shard:
                    if out:
                        close()
                    shard, n, sha = k, 0, hashlib.sha256()
                    tmp = f"{path}/{uuid.uuid4().hex}.part"
                    out = fs.open_output_stream(tmp, compression=None)
                if slot != shard * per_shard + n:
                    raise ValueError(f"slot {slot} is out of order")
                raw = rec.as_buffer()
                out.write(raw)
                sha.update(raw)
                n += 1
        if out:
            close()
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(done.values(), types)], names=list(done))

    manifest_at = scratch(spark, "manifest")
    schema = "shard long, path string, sequences long, first_slot long, bytes long, sha256 string"
    some = max(1, -(-shards // waves))  # shards of a wave
    with tidy_shuffles(spark):
        for first in range(0, max(1, shards), some):
            cut = cutter(first * per_shard, (first + some) * per_shard)
            records = table.select("bucket", "inner", "doc_id", "parts", "ids").mapInArrow(cut, "shard long, slot long, record binary")
            own = (F.col("shard") - first).cast("int")  # ranges of slots are known, so none need be sampled
            dealt = records.repartitionById(some, own).sortWithinPartitions("slot")
            dealt.mapInArrow(write, schema).write.mode("append").parquet(manifest_at)
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/format.part", compression=None) as f:
        f.write(json.dumps({"sequences": total, "per_shard": per_shard, "stride": stride, "length": length, "key": key, "end": end}).encode())
    put_in_place(fs, f"{path}/format.part", f"{path}/format.json")
    remove(spark, held)
    return spark.read.schema(schema).parquet(manifest_at)


class Reader:
    """Sequential and resumable reads of written shards, in training order."""

    def __init__(self, folder: str):
        self.fs, self.path = pa.fs.FileSystem.from_uri(folder)
        with self.fs.open_input_file(f"{self.path}/format.json") as f:
            self.format = json.loads(f.read())
        self.rtype = record_type(self.format["length"], self.format["end"] + 1)

    def read(self, slot: int, count: int) -> np.ndarray:
        """Records of `count` slots from `slot` on."""
        per, out = self.format["per_shard"], []
        while count > 0 and slot < self.format["sequences"]:
            shard, at = divmod(slot, per)
            n = min(count, per - at, self.format["sequences"] - slot)
            with self.fs.open_input_file(f"{self.path}/shard-{shard:06d}.bin") as f:
                f.seek(at * self.rtype.itemsize)
                out.append(np.frombuffer(f.read(n * self.rtype.itemsize), self.rtype))
            slot, count = slot + n, count - n
        return np.concatenate(out) if out else np.empty(0, self.rtype)

    def slot_of(self, sequence: int) -> int:
        return int(Feistel(self.format["sequences"], self.format["key"]).forward([sequence])[0])


def read_back(manifest: DataFrame, folder: str, batch: int = 4096) -> DataFrame:
    """Every sequence as it lies in the shards: slot, shard, doc_id, part, n_tokens, ids_sha1."""
    names = ("slot", "shard", "doc_id", "part", "n_tokens", "ids_sha1")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for b in it:
            for shard, first, n in zip(*(b.column(c).to_pylist() for c in ("shard", "first_slot", "sequences"))):
                for a in range(first, first + n, batch):
                    rec = reader.read(a, min(batch, first + n - a))
                    ids = pa.array([None if d == NO_ID else int(d) for d in rec["doc_id"]], pa.int64())
                    sums = [hashlib.sha1(r["ids"][: r["used"]].tobytes()).hexdigest() for r in rec]
                    columns = [pa.array(a + np.arange(len(rec))), pa.array(np.full(len(rec), shard)), ids, pa.array(rec["part"]), pa.array(rec["used"]), pa.array(sums, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return manifest.select("shard", "first_slot", "sequences").mapInArrow(read, "slot long, shard long, doc_id long, part int, n_tokens int, ids_sha1 string")


def materialised(docs: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Write the shards to `folder` (else in the shared folder) and read all of them back."""
    folder = folder or scratch(docs.sparkSession, "shards")
    manifest = write_shards(docs, folder, vocabulary, **options)
    return read_back(manifest.repartition(max(1, manifest.count())), folder)
