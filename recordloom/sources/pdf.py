"""Text layers of PDF files, a row for each page.

Files are read by Spark, pages of a file in its task. Objects are taken where they stand, so a
broken cross-reference table does no harm; later ones replace earlier ones, as updates
do. Streams are plain or deflated. Text is what is shown by strings of one byte a character
or UTF-16; fonts with a map of their own, encrypted files and images give no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)"
SHOWN = re.compile(rb"(?s)(" + STRING + rb")|<([0-9A-Fa-f\s]*)>|(-?\d*\.?\d+)|(Tj|TJ|T\*|Td|TD|Tm|ET|'|\")(?=[\s\[(<]|$)|(\[)|(\])")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
SPACE = -200  # a shift within shown text, in thousandths, that stands for a space


def inflated(head: bytes, data: bytes) -> bytes:
    if b"/FlateDecode" in head or b"/Fl " in head:
        return zlib.decompressobj().decompress(data)
    return b"" if b"/Filter" in head else data


def objects(raw: bytes) -> dict[int, tuple[bytes, bytes]]:
    """number -> (dictionary, stream decoded) of all objects, those within object streams too."""
    out: dict[int, tuple[bytes, bytes]] = {}
    at = 0
    while m := OBJECT.search(raw, at):
        end = raw.find(b"endobj", m.end())
        end = len(raw) if end < 0 else end
        begin = re.compile(rb"\bstream\r?\n").search(raw, m.end(), end)
        head, data = raw[m.end() : end], b""
        if begin:
            head = raw[m.end() : begin.start()]
            size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = begin.end() + int(size[1]) if size else -1
            if stop < 0 or not re.match(rb"\s*endstream", raw[stop : stop + 20]):
                stop = raw.find(b"endstream", begin.end())
            stop = len(raw) if stop < 0 else stop
            try:
                data = inflated(head, raw[begin.end() : stop])
            except zlib.error:
                data = b""
            end = max(stop, raw.find(b"endobj", stop))
        out[int(m[1])] = head, data
        if b"/ObjStm" in head and (first := re.search(rb"/First\s+(\d+)", head)):
            numbers = [int(x) for x in data[: int(first[1])].split()]
            ends = [*numbers[3::2], len(data) - int(first[1])]
            for number, a, b in zip(numbers[::2], numbers[1::2], ends):
                out[number] = data[int(first[1]) + a : int(first[1]) + b], b""
        at = max(end, m.end())
    return out


def text_of(shown: bytes) -> str:
    if shown.startswith(b"\xfe\xff"):
        return shown[2:].decode("utf-16-be", "replace")
    return shown.decode("cp1252", "replace")


def unescaped(s: bytes) -> bytes:
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], m[1])
    return re.sub(rb"(?s)\\([0-7]{1,3}|.)", one, s[1:-1])


def shown(content: bytes) -> str:
    """What the text operators of a page's content show, a line for each move to another."""
    out, held, numbers = [], [], []
    for m in SHOWN.finditer(content):
        if m[1] is not None:
            held.append(text_of(unescaped(m[1])))
        elif m[2] is not None:
            digits = re.sub(rb"\s", b"", m[2])
            held.append(text_of(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())))
        elif m[3] is not None:
            numbers.append(float(m[3]))
            if held and numbers[-1] < SPACE:
                held.append(" ")
        elif m[4] is not None:
            op = m[4]
            if op in (b"'", b'"', b"T*", b"Tm") or op in (b"Td", b"TD") and numbers[-1:] != [0.0]:
                out.append("\n")
            if op in (b"Tj", b"TJ", b"'", b'"'):
                out += held
            held, numbers = [], []
    return "\n".join(line.strip() for line in "".join(out).split("\n") if line.strip())


def pages(raw: bytes) -> list[str]:
    """The text of each page in order; none of a file that is no PDF or is encrypted."""
    if b"%PDF-" not in raw[:1024] or b"/Encrypt" in raw:
        return []
    found = objects(raw)
    first = lambda head, name: re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)

    def below(number: int, seen: frozenset[int]) -> Iterator[int]:
        head = found.get(number, (b"", b""))[0]
        if number not in seen and (kids := first(head, b"Kids")):
            for kid in REFERENCE.findall(kids[1]):
                yield from below(int(kid), seen | {number})
        elif re.search(rb"/Type\s*/Page\b(?!s)", head):
            yield number

    roots = [int(REFERENCE.search(t[1])[1]) for head, _ in found.values() if re.search(rb"/Type\s*/Catalog\b", head) and (t := first(head, b"Pages"))]
    order = [p for r in roots[-1:] for p in below(r, frozenset())] or [k for k, (head, _) in found.items() if re.search(rb"/Type\s*/Page\b(?!s)", head)]
    out = []
    for number in order:
        contents = first(found[number][0], b"Contents")
        parts = [int(x) for x in REFERENCE.findall(contents[1])] if contents else []
        nested = [int(x) for p in parts if found.get(p, (b"", b""))[0].strip().startswith(b"[") for x in REFERENCE.findall(found[p][0])]
        out.append(shown(b"\n".join(found[p][1] for p in nested or parts if p in found)))
    return out


def read_pdf_pages(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, page (from 1), page_count, blocks: one block for each page with text, without a place on it; no rows of a broken file."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, raw in zip(b.column("path"), b.column("content")):
                try:
                    texts = pages(raw.as_py() or b"")
                except (ValueError, KeyError, RecursionError):
                    texts = []
                if texts:
                    yield pa.RecordBatch.from_pydict({"path": [name.as_py()] * len(texts), "page": range(1, len(texts) + 1), "page_count": [len(texts)] * len(texts), "text": texts}, pa.schema([("path", pa.string()), ("page", pa.int32()), ("page_count", pa.int32()), ("text", pa.string())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    rows = files.mapInArrow(read, "path string, page int, page_count int, text string")
    block = F.struct(F.col("text"), F.array(*[F.lit(0.0)] * 4).alias("bbox"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("language"), F.lit("pypdf_text").alias("engine"))
    return rows.select("path", "page", "page_count", F.when(F.trim("text") != "", F.array(block)).otherwise(F.array().cast("array<struct<text:string,bbox:array<double>,confidence:double,language:string,engine:string>>")).alias("blocks"))
