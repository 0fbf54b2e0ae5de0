"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A conversation is rendered once; each example is a prefix of that rendering, so an example is a row of offsets:
context = [0, loss_start), trainable reply = [loss_start, loss_end), both in code points of the rendering. The
rendering itself is kept in blocks of at most `block` consecutive turn numbers, so that no task needs a whole
conversation; `example_texts` joins the blocks to each example's text.

Control strings in texts and roles are escaped reversibly: `<`, n backslashes, `|` becomes `<`, n+1 backslashes, `|`.
A line break in a role becomes the control string `<|nl|>`. So `<|` marks controls alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Columns conv_id, turn, role, text (others are ignored) to one row per conversation and block of turn numbers.

    Returns conv_id, block, n_turns, formatted (text of the block's turns), block_start (code points of the
    conversation before it) and examples: per assistant turn of the block turn, loss_start, loss_end (within the
    conversation). Turns are ordered by (turn, role, text), nulls first, but a null turn stands right before turn 0; equal rows all stay. Null text and null role
    are empty; a null conv_id is a conversation of its own; an empty table gives no rows.
    """
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block).cast("long").alias("block"),
    )
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    body = escape(F.col("text"))
    rendered = clean.select(
        "conv_id",
        "block",
        F.struct("turn", "role", "text", F.concat(head, body, F.lit(END)).alias("segment"), F.length(head).alias("head"), F.length(body).alias("body")).alias("t"),
    )
    blocks = rendered.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    size = lambda t: t["head"] + t["body"] + len(END)
    # Offsets within the block: the block's turns are bounded, so is this prefix sum.
    placed = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<turn:bigint,loss_start:bigint,loss_end:bigint>>)").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + size(t)).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["out"], F.array(F.struct(t["turn"].cast("long").alias("turn"), (acc["at"] + t["head"]).alias("loss_start"), (acc["at"] + t["head"] + t["body"]).alias("loss_end")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    blocks = blocks.select(
        "conv_id", "block", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda t: t["segment"]), "").alias("formatted"), placed.alias("p")
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumn("block_start", F.coalesce(F.sum("p.at").over(before), F.lit(0)).cast("long"))
    shift = lambda e: F.struct(e["turn"].alias("turn"), (e["loss_start"] + F.col("block_start")).alias("loss_start"), (e["loss_end"] + F.col("block_start")).alias("loss_end"))
    return out.select("conv_id", "block", "n_turns", "formatted", "block_start", F.transform("p.out", shift).alias("examples"))


def prefix_targets(blocks: DataFrame) -> DataFrame:
    """One example per assistant turn: conv_id, block, turn, loss_start, loss_end, example_chars (closing mark included) and target,
    the reply as rendered (escaped), the only trainable part; its context is what the conversation's blocks hold before loss_start."""
    target = lambda e: F.col("formatted").substr((e["loss_start"] - F.col("block_start") + 1).cast("int"), (e["loss_end"] - e["loss_start"]).cast("int"))
    cut = F.transform("examples", lambda e: F.struct(e["turn"].alias("turn"), e["loss_start"].alias("loss_start"), e["loss_end"].alias("loss_end"), (e["loss_end"] + len(END)).alias("example_chars"), target(e).alias("target")))
    return blocks.select("conv_id", "block", F.inline(cut))


def example_texts(blocks: DataFrame) -> DataFrame:
    """The examples with their texts: conv_id, turn, loss_start, loss_end, text.

    An example repeats all turns before it, so this output grows with the square of a conversation's length; use
    `prefix_targets` and the blocks where conversations are long.
    """
    b = blocks.select("conv_id", F.col("block").alias("of"), "block_start", "formatted").alias("b")
    e = prefix_targets(blocks).alias("e")
    parts = e.join(b, F.col("e.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("b.of") <= F.col("e.block")))
    cut = F.expr("substring(b.formatted, 1, int(least(length(b.formatted), e.example_chars - b.block_start)))")
    grouped = parts.groupBy("e.conv_id", "e.turn", "e.loss_start", "e.loss_end").agg(F.sort_array(F.collect_list(F.struct("b.of", cut.alias("part")))).alias("parts"))
    return grouped.select("conv_id", "turn", "loss_start", "loss_end", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def read_back(blocks: DataFrame) -> DataFrame:
    """Parse the rendering: conv_id, block, formatted and turns (array of role, text)."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)  # nothing stands before the first mark
    segments = F.slice(pieces, 2, F.size(pieces))
    role = lambda s: unescape(F.replace(F.substring_index(s, "\n", 1), F.lit(BREAK), F.lit("\n")))
    text = lambda s: unescape(s.substr(F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s) - F.length(F.substring_index(s, "\n", 1)) - 1 - len(END)))
    return blocks.select(
        "conv_id",
        "block",
        "formatted",
        F.transform(segments, lambda s: F.struct(role(s).alias("role"), text(s).alias("text"))).alias("turns"),
    )
