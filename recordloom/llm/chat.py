"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are its prefix and
only that reply, its target, is trained on. A row of `examples` has both written out, as
`context` and `target`; the example is the one followed by the other, and its loss mask,
[loss_start, loss_end), lies in the target. All examples of a conversation are prefixes of one formatted string,
so offsets into an example are offsets into that string too. `text`, [start, end) of it, is what the example adds to the
one before: the turns since then and the reply. Contexts grow with the square of a conversation's turns, as the
method's output does; none is shuffled or held beside another here. Turns after the last reply are a context without a target.

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside roles and texts "&" is written "&amp;", "<|" is "&lt;|" and a line feed in a
role is "&nl;", so a control string can only come from the template, and undoing the
three replacements in reverse order gives the text back.

Turns are numbered in chunks of `CHUNK` values of turn, with the totals of the chunks
before them added (a narrow row for each chunk), so a conversation with a third of all
rows, or all rows without a conv_id, is dealt over many tasks. A value of turn (or none)
that more than `CHUNK` rows of a conversation have is parted further, by a hash of role and text. A run of
turns that crosses a chunk's end is held in two rows, of which the last has the reply. The last
context of a conversation is nearly all of it, so `examples` brings each together in a row, or, with more than `BLOCK` replies,
in a row for each block of so many: the conversation up to the block's end, from which the block's examples are written out.
Of these `read_back` shuffles the replies only: what a conversation says is read from its last row, which has all of it.

Defined cases: null role or text: empty; turns are ordered by turn (null first), then by the
first three digits of md5 of role, line feed and text, then role, then text, and repeated
rows are turns of their own; a null conv_id is one conversation; turns after the last
reply are kept in a row without one, which is the last; very long texts are turns like others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"
#: Values of turn that are numbered together; those without a value come first.
CHUNK, NO_TURN = 4096, -(1 << 63)
#: Values of turn that are parted (some 40 bytes each) are broadcast up to this number and joined beyond it.
BROADCAST_VALUES = 500_000
#: Examples of a conversation that are written out from one row.
BLOCK = 1024


def _put(text: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape(text: Column) -> Column:
    return _put(text, ("&", "&amp;"), ("<|", "&lt;|"))


def unescape(text: Column) -> Column:
    return _put(text, ("&lt;|", "<|"), ("&amp;", "&"))


def escape_role(role: Column) -> Column:
    return _put(escape(role), ("\n", "&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(_put(role, ("&nl;", "\n")))


def _parted(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows with piece and sub, by which a chunk is numbered in parts: a value of turn that many rows have is
    pieces of its own, by hash, and the values before, between and after such are a piece each."""
    value = F.coalesce("turn", F.lit(NO_TURN))
    counts = rows.groupBy("key", "lone", "chunk", value.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    parted = F.sort_array(F.collect_list(F.struct("value", "n"))).alias("many")  # of the values of one chunk
    many = counts.groupBy(F.col("key").alias("k"), F.col("lone").alias("l"), F.col("chunk").alias("c")).agg(parted)
    few = counts.count() <= BROADCAST_VALUES
    found = rows.join(F.broadcast(many) if few else many, (F.col("key") == F.col("k")) & (F.col("lone") == F.col("l")) & (F.col("chunk") == F.col("c")), "left")
    held = F.get(F.filter("many", lambda m: m["value"] == value), F.lit(0))["n"]
    before = F.size(F.filter(F.coalesce("many", F.array().cast("array<struct<value:long,n:long>>")), lambda m: m["value"] < value))
    part = F.floor(F.conv("hash", 16, 10).cast("long") * F.ceil(held / chunk) / 4096).cast("long")
    dealt = found.withColumns({"piece": 2 * before + F.when(held.isNotNull(), 1).otherwise(0), "sub": F.coalesce(part, F.lit(0).cast("long"))}).drop("k", "l", "c", "many")
    return dealt if few else dealt.repartition("key", "lone", "chunk", "piece", "sub")


def format_turns(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each turn: conv_id (with key and lone, which stand for it), chunk, piece, sub, position, example, segment, start, end, is_target, loss_start, loss_end,
    and the replies and characters (all_replies, all_chars) of its conversation.

    Offsets are code points of the conversation's formatted string; `example` is the
    number, from 0, of the reply that the turn belongs to or comes before.
    """
    turn = F.col("turn").cast("long")
    body = escape(F.col("text"))
    hashed = F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = conversations.select(
        "conv_id",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"),
        F.col("conv_id").isNull().alias("lone"),
        F.coalesce(F.expr(f"(turn - pmod(turn, {chunk})) div {chunk}"), F.lit(NO_TURN)).alias("chunk"),
        turn.alias("turn"),
        F.substring(hashed, 1, 3).alias("hash"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = _parted(rows, chunk)
    segments = rows.select(
        "*",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), body, F.lit(END)).alias("segment"),
        F.length(body).cast("long").alias("body"),
        (F.col("role") == TARGET).alias("is_target"),
    )
    size, reply = F.length("segment").cast("long"), F.col("is_target").cast("long")
    parts = ["key", "lone", "chunk", "piece", "sub"]
    totals = segments.groupBy(*parts).agg(F.count(F.lit(1)).alias("turns"), F.sum(size).alias("chars"), F.sum(reply).alias("replies"))
    earlier = Window.partitionBy("key", "lone").orderBy("chunk", "piece", "sub").rowsBetween(Window.unboundedPreceding, -1)
    every = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("turns", "chars", "replies")]
    offsets = totals.select(*parts, *before, *[F.sum(c).over(every).alias(f"all_{c}") for c in ("chars", "replies")])
    order = Window.partitionBy(*parts).orderBy("turn", "hash", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    within = segments.select("*", F.row_number().over(order).alias("nth"), F.sum(size).over(so_far).alias("chars"), F.sum(reply).over(so_far).alias("replies"))
    placed = within.join(offsets, parts).withColumn("end", F.col("chars") + F.col("chars_before"))
    loss_end = F.col("end") - len(END)
    return placed.select(
        "conv_id",
        "key",
        "lone",
        "chunk",
        "piece",
        "sub",
        (F.col("nth") + F.col("turns_before")).cast("long").alias("position"),
        (F.col("replies") + F.col("replies_before") - reply).alias("example"),
        "segment",
        (F.col("end") - F.length("segment")).alias("start"),
        "end",
        "is_target",
        F.when(F.col("is_target"), loss_end - F.col("body")).alias("loss_start"),
        F.when(F.col("is_target"), loss_end).alias("loss_end"),
        "all_replies",
        "all_chars",
    )


def examples(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each assistant turn, and for turns that no reply follows: conv_id, example, chunk, context, target, text, start, end, context_end, loss_start, loss_end, is_last.

    `context` is the formatted string of all turns before the reply, which end at `context_end`, and `target` the formatted reply;
    `text` is [start, end) of that string, what the row adds to those before. Without a reply the context is of all turns up to
    `end`, and the last three offsets and the target are null. `is_last` marks the row that ends where its conversation does.
    """
    own = F.sort_array(F.collect_list(F.struct("position", "segment")))  # turns between two replies, of one chunk
    target = lambda c: F.max(F.when(F.col("is_target"), F.col(c)))
    each = turns.groupBy("key", "lone", "chunk", "piece", "sub", "example").agg(  # dealt as the turns were numbered, so not shuffled again
        F.max("conv_id").alias("conv_id"), F.array_join(own["segment"], "").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"),
        target("start").alias("context_end"), target("loss_start").alias("loss_start"), target("loss_end").alias("loss_end"), F.max("all_replies").alias("replies"), F.max("all_chars").alias("chars"),
    )
    blocks = F.sequence(F.floor(F.col("example") / block), F.floor(F.col("replies") / block))  # its own and those after it, mostly one
    names = ("start", "end", "example", "chunk", "context_end", "loss_start", "loss_end")
    added = F.sort_array(F.collect_list(F.struct("start", "text", *names[1:]))).alias("added")
    gathered = each.withColumn("block", F.explode(blocks)).groupBy("key", "lone", "block").agg(F.max("conv_id").alias("conv_id"), F.max("chars").alias("chars"), added)
    of_block = F.filter("added", lambda x: F.floor(x["example"] / block) == F.col("block"))
    found = gathered.select("conv_id", "chars", F.array_join("added.text", "").alias("whole"), F.transform(of_block, lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("added"))
    rows = found.select("conv_id", "chars", "whole", F.inline("added"))
    cut = lambda a, z: F.expr(f"substring(whole, cast({a} + 1 as int), cast({z} - {a} as int))")
    return rows.select(
        "conv_id", "example", "chunk", cut("0", "coalesce(context_end, end)").alias("context"), cut("context_end", "end").alias("target"), cut("start", "end").alias("text"),
        "start", "end", "context_end", "loss_start", "loss_end", (F.col("end") == F.col("chars")).alias("is_last"),
    )


def render(found: DataFrame) -> DataFrame:
    """The examples as single texts: conv_id, example, text, loss_start, loss_end."""
    return found.filter("loss_end is not null").select("conv_id", "example", F.concat("context", "target").alias("text"), "loss_start", "loss_end")


def read_back(found: DataFrame) -> DataFrame:
    """What the examples say, parsed from their texts and loss masks: one row for each conversation.

    Turns are read from the last example, losses cut out of each. `context_chars` sums the contexts of replies; `n_contexts` counts those of
    them that end with an ended turn, at `context_end`, in the turns that the example's text has before its reply, and are followed by the
    reply's one turn, of which the loss mask covers all but the template.
    """
    segments = F.filter(F.split("whole", r"<\|im_end\|>\n"), lambda s: s != "")
    inner = F.transform(segments, lambda s: F.substring(s, F.lit(len(START) + 1), F.length(s)))
    said = F.transform(inner, lambda s: F.concat(unescape_role(F.substring_index(s, "\n", 1)), F.lit("\n"), unescape(F.substring(s, F.instr(s, "\n") + 1, F.length(s))), F.lit("\n")))
    reply, head, size = F.col("loss_end").isNotNull(), START + TARGET + "\n", F.length("context").cast("long")
    loss = unescape(F.expr("substring(target, cast(loss_start - length(context) + 1 as int), cast(loss_end - loss_start as int))"))
    since = F.expr(f"substring(text, 1, cast(length(text) - length(substring_index(text, '{START}', -1)) - {len(START)} as int))")  # turns since the last reply
    ends = (F.col("context_end") == size) & ((size == 0) | F.endswith("context", F.lit(END))) & F.endswith("context", since)
    one = F.col("target") == F.concat(F.lit(head), F.substring_index(F.substring_index("target", head, -1), END, 1), F.lit(END))
    masked = (F.col("loss_start") == size + len(head)) & (F.col("loss_end") == size + F.length("target") - len(END))
    parsed = found.select("conv_id", "start", reply.cast("long").alias("reply"), F.when(reply, size).alias("size"), (reply & ends & one & masked).cast("long").alias("context"), F.coalesce(loss, F.lit("")).alias("loss"),
        F.when(F.col("is_last"), F.concat("context", F.coalesce("target", F.lit("")))).alias("whole"))
    read = parsed.select("conv_id", "start", "reply", "size", "context", "loss", F.when(F.col("whole").isNotNull(), F.struct(F.size(segments).cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("sha"), F.length("whole").cast("long").alias("chars"))).alias("last"))
    each = F.sort_array(F.collect_list(F.struct("start", "loss")))
    whole = read.groupBy("conv_id").agg(each.alias("parts"), F.max("last").alias("last"), F.sum("reply").alias("n_examples"), F.coalesce(F.sum("size"), F.lit(0)).alias("context_chars"), F.sum("context").alias("n_contexts"))
    joined = whole.select("*", F.array_join("parts.loss", "").alias("loss"))
    return joined.select(
        "conv_id",
        "last.n_turns",
        F.col("last.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("last.chars").alias("formatted_chars"),
        "n_examples",
        "context_chars",
        "n_contexts",
    )
