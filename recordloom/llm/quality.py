"""Quality rules with host-level verdicts.

Every document is measured and held against rules. Failures are summed for each
host; the rates are shrunk towards a beta prior fitted to all hosts by the method of
moments, and a host whose shrunk rate is above `host_limit` loses its documents too.

Defined cases: a null text has no words and fails the base rules; very long texts are
measured whole; null hosts form one host; repeated rows count each; an empty table gives
an empty result; other columns are ignored, or kept in one value, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, materialise, packed, text_or_empty, words

#: Symbols counted as noise.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Rules besides the base ones, for host rates only: symbols to words, repeated lines to words.
SYMBOL_RATIO, LINE_RATIO = 0.5, 0.05
HOST_LIMIT = 0.5
#: Rejected hosts up to this number are broadcast; more are joined with hosts split in so many parts.
BROADCAST_HOSTS, SALTS = 100_000, 64


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words of the array that lie in a window of `window` words found twice or more in it.

    Windows are told apart by a hash first; only an array in which hashes repeat has
    its windows sorted as strings, which settles every case exactly.
    """
    starts = lambda a: F.sequence(F.lit(0), F.size(a) - window)

    def some_hash_repeats(a: Column) -> Column:
        hashed = F.transform(a, lambda x: F.xxhash64(x))
        keys = let(hashed, lambda h: F.transform(starts(h), lambda i: F.xxhash64(F.slice(h, i + 1, F.lit(window)))))
        return let(keys, lambda k: F.size(F.array_distinct(k)) < F.size(k))

    def covered(a: Column) -> Column:
        grams = F.sort_array(F.transform(starts(a), lambda i: F.struct(F.array_join(F.slice(a, i + 1, F.lit(window)), " ").alias("g"), i.alias("i"))))

        def positions(g: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(g, i)["g"] == F.get(g, j)["g"], F.lit(False))
            hits = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.sort_array(F.transform(hits, lambda i: F.get(g, i)["i"]))

        def united(p: Column) -> Column:
            gaps = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1), F.get(p, i) + window) - F.get(p, i)))
            return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

        return let(let(grams, positions), lambda p: F.when(F.size(p) > 0, united(p)).otherwise(0))

    return let(w, lambda a: F.when(F.size(a) >= window, F.when(some_hash_repeats(a), covered(a)).otherwise(0)).otherwise(0)).cast("long")


def measure(docs: DataFrame, host: str = "source", carry: bool = False) -> DataFrame:
    """Counts of every whole text: doc_id, __host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; with `carry`, its row."""
    text = text_or_empty()
    own = [packed(docs).alias("row")] if carry else []
    base = docs.select("doc_id", *own, F.col(host).alias("__host"), text.alias("__text"), words(text).alias("__words"))
    return base.select(
        *(["doc_id", "row"] if carry else ["doc_id"]),
        "__host",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def any_failed() -> Column:
    noisy = F.col("n_symbols") > SYMBOL_RATIO * F.col("n_words")
    lines = F.col("n_dup_lines") > LINE_RATIO * F.col("n_words")
    return base_failed() | noisy | lines


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT, failed: Column | None = None) -> DataFrame:
    """__host, docs, failures, shrunk rate and verdict.

    The prior's mean m is the mean rate over documents; its strength follows from the
    between-host variance, v = sum n (r - m)^2 / sum n less the binomial part, as
    a + b = m (1 - m) / v - 1, held to 1..1e6. Rates equal on all hosts give the
    strongest prior. Only that one row of sums reaches the driver.
    """
    hosts = measured.groupBy("__host").agg(F.count(F.lit(1)).alias("docs"), F.sum((any_failed() if failed is None else failed).cast("long")).alias("failures"))
    n, f = F.col("docs").cast("double"), F.col("failures").cast("double")
    s = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.count(F.lit(1)).alias("k")).first()
    total, k = s["n"] or 0.0, s["k"]
    mean = (s["f"] or 0.0) / total if total else 0.0
    spread = max(0.0, ((s["ff"] or 0.0) - total * mean * mean) / total - mean * (1 - mean) * k / total) if total else 0.0
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    rate = (f + mean * strength) / (n + strength)
    return hosts.select("*", rate.alias("host_rate"), (rate <= limit).alias("host_kept"))


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Every document with its counts, base_failed, host_rate and kept.

    The text is read once: counts are kept as a narrow table in the shared folder,
    summed by host before any shuffle, and joined with a row for each host; adaptive
    execution splits a hot host's side of that join.
    """
    measured = materialise(measure(docs, host), "quality")
    verdicts = host_verdicts(measured, limit).select(F.col("__host").alias("__h"), "host_rate", "host_kept")
    joined = measured.join(verdicts, F.col("__host").eqNullSafe(F.col("__h")))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & F.col("host_kept")).alias("kept"),
        "host_rate",
    )


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass the base rules on hosts that pass, with their columns.

    Each text is measured once: rows are kept in the shared folder with their verdicts,
    those that fail the base rules without their columns. Hosts are judged from the
    verdicts, and rejected hosts, which are few, are taken out; a host with a third of all
    rows never meets in one task. Other columns may have any names.
    """
    counts = measure(docs, host, carry=True)
    marked = materialise(counts.select("__host", any_failed().alias("failed"), F.when(~base_failed(), F.col("row")).alias("row")), "quality")
    verdicts = host_verdicts(marked, limit, F.col("failed"))
    bad = materialise(verdicts.filter(~F.col("host_kept")).select(F.col("__host").alias("bad")), "hosts")
    good = marked.filter(F.col("row").isNotNull())
    n = bad.count()
    if n == 0:
        return good.select("row.*")
    same = F.col("__host").eqNullSafe(F.col("bad"))
    if n <= BROADCAST_HOSTS:
        return good.join(F.broadcast(bad), same, "left_anti").select("row.*")
    salted = good.withColumn("salt", F.pmod(F.xxhash64("row.doc_id", F.octet_length("row.text")), F.lit(SALTS)).cast("int"))
    every = bad.select("bad", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    return salted.join(every, same & (F.col("salt") == F.col("s")), "left_anti").select("row.*")
