"""WARC archives: writing them, normalising monolithic gzip files, reading by index.

A crawl writes each archive as one gzip stream, which has to be inflated from its
start to reach any record. The normaliser inflates such a file once, rewrites every
record as a gzip member of its own and writes a sidecar index (offset, length, id,
type, digest), after which any record is one short read.

Archives are files in a folder that driver and executors share; it is reached through
pyarrow's file systems, so a URI of file, hdfs, s3 or gs will do. A task writes under a
name of its own and renames at the end: a task that is lost and run again leaves whole
files only, and the index names the files that count.

Each archive opens with a warcinfo record; a revisit names its response by record id.

Defined cases: a null html is an empty payload; a very long one is a record like others; equal payloads of `least` bytes or more
are stored once, in the record with the largest page_id (null last; of equal ids all are
stored), the rest are revisits; repeated rows each have a record; other columns
are ignored; no rows, no archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, put_in_place, scratch, tidy_shuffles

CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
#: Digests that occur twice or more, up to this number (48 bytes each), are broadcast, so payloads are not shuffled; more are joined.
BROADCAST_DIGESTS = 500_000
GZIP = 31  # zlib's window bits for a gzip wrapper

INDEX = "archive string, offset long, length long, page_id long, record_type string, digest string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, offset long, archive string"


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def hex_of(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def page_uri(page_id: int | None) -> str:
    return "urn:page:" + ("null" if page_id is None else str(page_id))


def page_of(uri: str) -> int | None:
    last = uri.rpartition(":")[2]
    return None if last == "null" else int(last)


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    """A record's id follows from what it holds, so a revisit can name its response before that is written; equal rows share theirs."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_uri(page_id)} {digest} {kind}')}>"


def assembled(head: list[tuple[str, str]], block: bytes) -> bytes:
    head = [*head, ("Content-Length", str(len(block)))]
    return b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head) + CRLF + block + CRLF + CRLF


def warcinfo(name: str) -> bytes:
    """The record that opens an archive."""
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return assembled(head, b"software: recordloom\r\nformat: WARC File Format 1.1\r\n")


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC 1.1 record. A revisit has the HTTP head only; its length header keeps the payload's."""
    http = HTTP % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest, kind)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Page-ID", page_uri(page_id)),
        ("WARC-Payload-Digest", base32(digest)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest, "response")), ("WARC-Refers-To-Page-ID", page_uri(refers_to))]
    return assembled(head, block)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of an inflated stream, holding one record at a time."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        for c in chunks:
            held.extend(c)
            return True
        return False

    while held or more():
        start = 0
        while (end := held.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(held) - 3)
            if not more():
                raise ValueError("a record's header is cut off")
        head = parse_head(bytes(held[:end]))
        size = end + 4 + int(head["Content-Length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("a record is cut off")
        yield head, bytes(held[:size])
        del held[:size]


def inflate(f, block: int = 1 << 20, most: int = 16 << 20) -> Iterator[bytes]:
    """Inflated pieces of a gzip file of one member or many, `most` bytes at a time."""
    z = None
    while raw := f.read(block):
        while raw:
            if z is None or z.eof:
                z = zlib.decompressobj(GZIP)
            if out := z.decompress(raw, most):
                yield out
            raw = z.unused_data if z.eof else z.unconsumed_tail
    if z is not None and not z.eof:
        if not (out := z.flush()) or not z.eof:
            raise ValueError("the gzip stream is cut off")
        yield out


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


def opened(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return fs, path


def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type and refers_to for every page.

    The largest page_id of each digest is found with map-side combining over narrow rows,
    and only digests that occur twice come back.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    large = F.octet_length("payload") >= least
    holders = rows.filter(large).groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    holders = materialise(holders.filter("n > 1").select(F.col("payload_digest").alias("digest"), "holder"), "holders")
    few = holders.count() <= BROADCAST_DIGESTS
    joined = rows.join(F.broadcast(holders) if few else holders, large & (F.col("payload_digest") == F.col("digest")), "left")
    again = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("holder")).alias("refers_to"),
    )


def write_monolithic(pages: DataFrame, folder: str, level: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives as whole-file gzip streams; the names of the finished files."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        names, out, z, n, name = [], None, None, 0, ""

        def close():
            out.write(z.flush())
            out.close()
            put_in_place(fs, f"{path}/{name}.part", f"{path}/{name}")
            names.append(name)

        for b in it:
            for page_id, url, payload, digest, kind, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to"))):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out, z = fs.open_output_stream(f"{path}/{name}.part", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    out.write(z.compress(warcinfo(name)))
                data = record(page_id, url, payload, digest, kind, ref)
                out.write(z.compress(data))
                n += len(data)
                if n >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    return pages.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(write, "archive string")


def normalise(archives: DataFrame, source: str, target: str, level: int = 6, drop_source: bool = False) -> DataFrame:
    """Rewrite archives with a gzip member for each record; the rows of their sidecar indexes.

    A sidecar NAME.idx.parquet stands beside each archive with the same rows. Every attempt
    of a task writes under names of its own, so one that is run again meets no file of an
    earlier one; the rows returned name the files that count.
    """
    import pyarrow.parquet as pq

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, src), (to_fs, dst) = opened(source), opened(target)
        to_fs.create_dir(dst, recursive=True)
        for b in it:
            for name in b.column("archive").to_pylist():
                own = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                at, index = 0, []
                with fs.open_input_stream(f"{src}/{name}", compression=None) as f, to_fs.open_output_stream(f"{dst}/{own}.part", compression=None) as out:
                    for head, data in records(inflate(f)):
                        packed = member(data, level)
                        out.write(packed)
                        page, digest = head.get("WARC-Page-ID"), head.get("WARC-Payload-Digest")  # a warcinfo has neither
                        index.append((own, at, len(packed), page and page_of(page), head["WARC-Type"], digest and hex_of(digest)))
                        at += len(packed)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r[k] for r in index], t) for k, t in enumerate(types)]
                batch = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])
                pq.write_table(pa.Table.from_batches([batch]), f"{dst}/{own}.idx.part", filesystem=to_fs)
                put_in_place(to_fs, f"{dst}/{own}.idx.part", f"{dst}/{own}.idx.parquet")
                put_in_place(to_fs, f"{dst}/{own}.part", f"{dst}/{own}")
                if drop_source:
                    fs.delete_file(f"{src}/{name}")
                yield batch

    return archives.mapInArrow(rewrite, INDEX)


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every page's record named by the index, parsed from its own member and checked against its digest."""

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        name, f = None, None
        for b in it:
            out = {c.split()[0]: [] for c in READ.split(", ")}
            for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if f:
                        f.close()
                    name, f = archive, fs.open_input_file(f"{path}/{archive}")
                f.seek(offset)
                data = zlib.decompress(f.read(length), GZIP)
                head, _, rest = data.partition(b"\r\n\r\n")
                head = parse_head(head)
                http, _, body = rest[: int(head["Content-Length"])].partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2])
                kind, digest = head["WARC-Type"], hex_of(head["WARC-Payload-Digest"])
                if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                    raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                ref = page_of(head["WARC-Refers-To-Page-ID"]) if kind == "revisit" else None
                if kind == "revisit" and head["WARC-Refers-To"] != record_id(ref, digest, "response"):
                    raise ValueError(f"{archive} at {offset}: it refers to another record than its page's")
                for k, v in zip(out, (page_of(head["WARC-Page-ID"]), size, digest, kind, ref, head["WARC-Target-URI"], offset, archive)):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
        if f:
            f.close()

    return index.filter("record_type <> 'warcinfo'").select("archive", "offset", "length").mapInArrow(parse, READ)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write, normalise and read back; lists of files and offsets are kept as small tables."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    names = f"{folder}/names"
    with tidy_shuffles(spark):  # payloads were shuffled; that is over once they are in archives
        write_monolithic(decided(pages, least), f"{folder}/raw").write.parquet(names)
    archives = spark.read.schema("archive string").parquet(names)
    n = max(1, archives.count())
    index_at = f"{folder}/index"
    normalise(archives.repartition(n), f"{folder}/raw", f"{folder}/members").write.parquet(index_at)
    index = spark.read.schema(INDEX).parquet(index_at)
    return read(index, f"{folder}/members")
