"""Exact and content duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import key_form


def file_duplicates(docs: DataFrame) -> DataFrame:
    """document_id, duplicate_of, copies: every file whose hash another has too.

    Copies are not expanded into pairs: each points at the first of its group.
    """
    groups = docs.filter(F.col("file_hash").isNotNull()).groupBy("file_hash").agg(F.min("document_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    many = groups.filter("copies > 1")
    return docs.join(many, "file_hash").select("document_id", "file_hash", F.col("first").alias("duplicate_of"), "copies")


def key_values(fields: DataFrame, keys: list[str] = V.DUPLICATE_KEYS) -> DataFrame:
    """The last value of each document and key, as compared."""
    known = fields.filter(F.col("canonical_key").isin(keys) & (key_form(F.col("field_value")) != ""))
    return known.groupBy("document_id", "canonical_key").agg(F.max_by(key_form(F.col("field_value")), "seq").alias("value"))


def groups(values: DataFrame, keys: list[str], id_: str = "document_id") -> DataFrame:
    """document_id, group_id, the keys: documents that agree on every key (nulls too) share a group, named by its lowest id.

    The lowest id comes from an aggregate that is combined before its shuffle, and is
    joined back by a hash of the keys with the keys themselves as the condition.
    """
    hashed = values.select(id_, F.xxhash64(*keys).alias("hash"), *keys)
    lowest = hashed.groupBy("hash", *keys).agg(F.min(id_).alias("group_id"))
    same = F.col("v.hash") == F.col("g.hash")
    for c in keys:
        same &= F.col(f"v.{c}").eqNullSafe(F.col(f"g.{c}"))
    return hashed.alias("v").join(lowest.alias("g"), same).select(F.col(f"v.{id_}").alias("document_id"), "group_id", *[F.col(f"v.{c}").alias(c) for c in keys])


def _given(keys: list[str], of: str = "") -> Column:
    """The names of the keys that a row has."""
    return F.filter(F.array(*[F.when(F.col(f"{of}{c}").isNotNull(), c) for c in keys]), lambda x: x.isNotNull())


def blocks(values: DataFrame, keys: list[str], k: int, id_: str = "document_id") -> DataFrame:
    """group_id, subset, first: every k keys that a group has, and the lowest group that agrees on them.

    `values` is wide, a column for each key. Documents equal on all keys are one group, named
    by its lowest id; groups that agree on k keys share a block, whoever else is in it.
    Rows are those of groups times subsets: nobody is paired with all others of a block.
    """
    each = values.groupBy(*keys).agg(F.min(id_).alias("group_id"))
    parts = F.array(*[
        F.when(F.concat(*[F.col(c) for c in part]).isNotNull(), F.struct(F.lit(",".join(part)).alias("subset"), F.array(*part).alias("said")))
        for part in combinations(keys, k)
    ])
    dealt = each.select("group_id", F.explode(F.filter(parts, lambda b: b.isNotNull())).alias("block")).select("group_id", "block.subset", "block.said")
    least = dealt.groupBy("subset", "said").agg(F.min("group_id").alias("first"))
    return dealt.join(least, ["subset", "said"]).select("group_id", "subset", "first")


def content_duplicates(values: DataFrame, keys: list[str] = V.DUPLICATE_KEYS, least: int = 3, id_: str = "document_id") -> DataFrame:
    """document_id, duplicate_id, kind, matched, matched_keys, similarity (matches over the document's own keys: not symmetric).

    Of kind `group`: a group of documents that agree on all keys, named by its lowest id, and
    the first group of a block that it is in, with all keys on which these two agree. Of kind
    `member`: each other document of a group with that lowest id. Two documents are
    duplicates if they are of one group with `least` keys or more, or of groups that share a
    block: neither copies nor blocks are expanded into pairs. `duplicates_of` does that
    for documents that are asked for.
    """
    members = groups(values, keys, id_).select("document_id", F.col("group_id").alias("duplicate_id"), _given(keys).alias("matched_keys"))
    inside = members.filter((F.col("document_id") != F.col("duplicate_id")) & (F.size("matched_keys") >= least)).select("*", F.size("matched_keys").alias("n"), F.lit("member").alias("kind"))
    stars = blocks(values, keys, least, id_).filter("group_id <> first").select(F.col("group_id").alias("document_id"), F.col("first").alias("duplicate_id")).distinct()
    side = lambda name, id2: values.select(F.col(id_).alias(id2), *[F.col(c).alias(f"{name}{c}") for c in keys])
    both = stars.join(side("a_", "document_id"), "document_id").join(side("b_", "duplicate_id"), "duplicate_id")
    same = F.filter(F.array(*[F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), c) for c in keys]), lambda x: x.isNotNull())
    between = both.select("document_id", "duplicate_id", same.alias("matched_keys"), F.size(_given(keys, "a_")).alias("n"), F.lit("group").alias("kind"))
    out = between.unionByName(inside)
    return out.select("document_id", "duplicate_id", "kind", F.size("matched_keys").alias("matched"), "matched_keys", (F.size("matched_keys") / F.col("n")).alias("similarity"))


def content_pairs(values: DataFrame, keys: list[str] = V.DUPLICATE_KEYS, least: int = 3, id_: str = "document_id") -> DataFrame:
    """The columns of `content_duplicates`, with every link between different groups instead of those with the first of a block.

    Of kind `group`: each two groups with `least` keys in common, both ways, each named by its
    lowest id. Of kind `member`: each other document of a group with that lowest id. Copies are not
    expanded; links between groups are, as many as there are. Two groups meet on each
    subset of keys that they share and are linked at the first of these only, so pairs
    are not shuffled to make them distinct.
    """
    named = groups(values, keys, id_)
    given = F.size(_given(keys))
    copies = named.filter((F.col("document_id") != F.col("group_id")) & (given >= least))
    inside = copies.select("document_id", F.col("group_id").alias("duplicate_id"), _given(keys).alias("matched_keys"), given.alias("n"), F.lit("member").alias("kind"))
    each = named.filter("document_id = group_id").select("group_id", F.array(*keys).alias("own"), given.alias("n"))
    said = lambda part: F.array(*[F.get("own", F.lit(keys.index(c))) for c in part])
    parts = [F.when(F.forall(said(part), lambda x: x.isNotNull()), F.struct(F.lit(",".join(part)).alias("subset"), said(part).alias("said"))) for part in combinations(keys, least)]
    dealt = each.select("*", F.explode(F.filter(F.array(*parts), lambda b: b.isNotNull())).alias("block")).select("group_id", "own", "n", "block.subset", F.xxhash64("block.subset", "block.said").alias("hash"))
    same = F.filter(F.array(*[F.when(F.get("x.own", F.lit(i)) == F.get("y.own", F.lit(i)), c) for i, c in enumerate(keys)]), lambda c: c.isNotNull())
    meet = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.subset") == F.col("y.subset")) & (F.col("x.group_id") != F.col("y.group_id"))
    met = dealt.alias("x").join(dealt.hint("merge").alias("y"), meet).select(F.col("x.group_id").alias("document_id"), F.col("y.group_id").alias("duplicate_id"), same.alias("matched_keys"), F.col("x.n").alias("n"), "x.subset")
    between = met.filter(F.array_join(F.slice("matched_keys", 1, least), ",") == F.col("subset")).drop("subset").withColumn("kind", F.lit("group"))
    out = between.unionByName(inside)
    return out.select("document_id", "duplicate_id", "kind", F.size("matched_keys").alias("matched"), "matched_keys", (F.size("matched_keys") / F.col("n")).alias("similarity"))


def duplicates_of(values: DataFrame, asked: DataFrame, keys: list[str] = V.DUPLICATE_KEYS, least: int = 3, id_: str = "document_id") -> DataFrame:
    """document_id, duplicate_id, matched_keys, similarity of all duplicates of the documents asked for: their lists, not the table's."""
    named = groups(values, keys, id_)
    mine = named.join(asked.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "group_id", *[F.col(c).alias(f"a_{c}") for c in keys])
    dealt = blocks(values, keys, least, id_)
    near = mine.select("document_id", "group_id").join(dealt, "group_id").select("document_id", "subset", "first")
    others = near.join(dealt, ["subset", "first"]).select("document_id", F.col("group_id").alias("other")).distinct()
    theirs = named.select(F.col("document_id").alias("duplicate_id"), F.col("group_id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in keys])
    found = mine.drop("group_id").join(others, "document_id").join(theirs, "other").filter("document_id <> duplicate_id")
    same = F.filter(F.array(*[F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), c) for c in keys]), lambda x: x.isNotNull())
    return found.select("document_id", "duplicate_id", same.alias("matched_keys"), (F.size(same) / F.size(_given(keys, "a_"))).alias("similarity"))


def report(files: DataFrame, contents: DataFrame) -> DataFrame:
    """File duplicates first; content duplicates for pairs not listed."""
    a = files.select("document_id", "duplicate_id", F.lit("file_content").alias("reason"), F.lit(1.0).alias("similarity"))
    b = contents.select("document_id", "duplicate_id", F.lit("field_content").alias("reason"), "similarity")
    return a.unionByName(b.join(a, ["document_id", "duplicate_id"], "left_anti"))
