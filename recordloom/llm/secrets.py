"""Secret scanning: patterns, and a token-efficiency test for random strings.

Language compresses well under a byte-pair vocabulary; random keys do not. A run of
key characters whose characters-per-token ratio is low is reported as `random`, after
taking out what is random by nature but public: digests of the usual lengths, UUIDs,
and plain identifiers (numbers, words, addresses, paths).

Spans are code points, end exclusive, written kind:start:end. A null text counts as
empty and has no spans; a very long text is scanned whole; every row is scanned on its
own, so ties and repeated rows keep their own results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A match of ASSIGN has one of these, in lower case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: The same matches as AKIA[A-Z0-9]+ of 16 and [0-9a-f]+ of 32 characters or more: a run fails or holds as a whole.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Key-like runs: of so many characters a ratio says something.
SHORTEST = 16
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}(?![A-Za-z0-9+/_=-])")
WORD = re.compile(r"([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}")
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
DIGEST = re.compile(r"(?:(?:md5|sha1|sha256|sha384|sha512)[-:_]?)?[0-9a-f]+", re.I)
#: Hexadecimal lengths of md5, sha1, sha224, sha256, sha384 and sha512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
#: GPT-2 style splitting; of no matter for the runs, which hold no white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_RATIO = 2.1

_encoders: dict[str, object] = {}


def encoder(vocabulary: str, ranks: bytes | None = None):
    """The tiktoken encoding of a rank file (or of its bytes, as sent to executors), kept by each Python worker."""
    if vocabulary not in _encoders:
        import tiktoken

        if ranks is None:
            with open(vocabulary, "rb") as f:
                ranks = f.read()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[vocabulary] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[vocabulary]


def shipped(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The rank file's bytes, about a megabyte, so that executors need no such file."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def known(run: str) -> bool:
    """Digests and numbers: random or long by nature, not secret."""
    bare = run.rstrip("=")
    if UUID.fullmatch(bare) or DIGEST.fullmatch(bare) and len(re.sub(r"^.*[-:_]", "", bare)) in DIGEST_LENGTHS:
        return True
    return not re.search("[A-Za-z]", bare)


def named(run: str, enc, max_ratio: float) -> bool:
    """Names: at least half of a run's letters, numbers by themselves aside, are in words that the vocabulary compresses well.

    A word is a part between separators of letters of one case (or with a capital first), with a
    few digits at its end or not; one of up to four letters is a word if it is one token.
    Words are judged together, as single short ones say little.
    """
    words, chars, tokens = [], 0, 0
    for p in re.split(r"[-_/+]", run.rstrip("=")):
        if p.isdigit() or not p:
            continue
        chars += len(p)
        m = WORD.fullmatch(p)
        if m:
            n = len(enc.encode_ordinary(m[1]))
            if len(m[1]) > 4 or n == 1:
                words.append(len(p))
                tokens += n
    return 2 * sum(words) >= chars and sum(words) >= max_ratio * tokens


def base_spans(text: str) -> list[tuple[int, int, int]]:
    spans = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, found: list[tuple[int, int, int]], enc, max_ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, _, e in found) or known(m[0]):
            continue
        if len(m[0]) < max_ratio * len(enc.encode_ordinary(m[0])) and not named(m[0], enc, max_ratio):  # the same test for all runs
            out.append((a, 3, b))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def scan(docs: DataFrame, vocabulary: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row for each document with its counts and spans; a narrow map, nothing is shuffled."""
    ranks = shipped(docs.sparkSession, vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks.value)
        for b in it:
            rows = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")}
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                more = random_spans(text, base, enc, max_ratio)
                for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                    rows[n].append(sum(s[1] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                rows["spans"].append(written(sorted(base + more)))
                rows["n_random"].append(len(more))
            types = {"base_sha256": pa.string(), "spans": pa.string()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, types.get(n, pa.int64())) for n, v in rows.items())], names=["doc_id", *rows])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches, RESULT)
