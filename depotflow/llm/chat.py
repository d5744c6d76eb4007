"""Chat formatting with Spark expressions only: turns in order, neighbours of one role merged, control strings escaped.

A conversation becomes one string of blocks, one for each run of turns of the same role:

    <turn>ROLE<says>TEXT<and>TEXT<end>

followed by a line break. Inside roles and texts a backslash becomes \\b and < becomes \\l, so only control strings hold <
and everything can be read back. The loss mask lists the code points of assistant texts as (start, stop) spans.

Offsets are running sums over the turns, so the work is linear in the length of a conversation; turns are formatted as rows and
merged in two steps, blocks first. One conversation is one row of the output, which must fit into a task.

Nulls: null texts and roles are empty; null turns come first; equal turns are ordered by role and text, repeated rows
stay. A null conv_id is a conversation of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

TURN, SAYS, AND, END = "<turn>", "<says>", "<and>", "<end>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss: array of spans) from (conv_id, turn, role, text); other columns are ignored."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lag("role").over(order)
    marker = (
        F.when(last.isNull(), F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
        .when(last != F.col("role"), F.concat(F.lit(END + TURN), escape(F.col("role")), F.lit(SAYS)))
        .otherwise(F.lit(AND))
    )
    rows = rows.withColumns({"marker": marker, "n": F.row_number().over(order), "text": escape(F.col("text"))})
    stop = F.sum(F.char_length("marker") + F.char_length("text")).over(upto)
    rows = rows.withColumns({"stop": stop, "block": F.sum((F.col("marker") != AND).cast("long")).over(upto)})
    span = F.struct((F.col("stop") - F.char_length("text")).alias("start"), "stop")
    blocks = rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("n", F.concat("marker", "text").alias("piece"), span.alias("span")))).alias("turns"),
        (F.first("role") == learned_role).alias("learned"),
    )
    blocks = blocks.select(
        "conv_id", "block", F.array_join("turns.piece", "").alias("piece"), F.when(F.col("learned"), F.col("turns.span")).alias("spans")
    )
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "piece", "spans"))).alias("blocks"))
    return whole.select(
        "conv_id",
        F.concat(F.array_join("blocks.piece", ""), F.lit(END)).alias("formatted"),
        F.flatten(F.filter("blocks.spans", lambda s: s.isNotNull())).alias("loss"),
    )


def read_turns(chats: DataFrame) -> DataFrame:
    """(conv_id, n, role, text, learned) of every turn, from what `format_chats` returned."""
    parts = chats.select("conv_id", F.posexplode(F.split("formatted", "<")).alias("n", "part"))  # nothing stands before the first <
    tag = F.substring_index("part", ">", 1)
    body = F.col("part").substr(F.char_length(tag) + 2, F.char_length("part"))
    order = Window.partitionBy("conv_id").orderBy("n")
    begins = F.sum(F.char_length("part") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    parts = parts.withColumns({"tag": tag, "body": body, "start": begins - F.char_length(body)})
    role = F.last(F.when(F.col("tag") == "turn", F.col("body")), ignorenulls=True)
    parts = parts.withColumn("role", role.over(order)).filter(F.col("tag").isin("says", "and"))
    spans = chats.select(F.col("conv_id").alias("_conv"), F.explode("loss").alias("_span"))
    masked = spans.select("_conv", F.col("_span.start").alias("_start"), F.col("_span.stop").alias("_stop"), F.lit(True).alias("_learned"))
    under = (
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("start") == F.col("_start"))
        & (F.col("start") + F.char_length("body") == F.col("_stop"))
    )
    # an empty text may start where a span does; it must also end there
    return parts.join(masked.distinct(), under, "left").select(
        "conv_id", "n", unescape(F.col("role")).alias("role"), unescape(F.col("body")).alias("text"), F.coalesce("_learned", F.lit(False)).alias("learned")
    )


def digests(chats: DataFrame) -> DataFrame:
    """One row for each conversation: its turns and what the loss mask covers, as digests, read back from the strings."""
    turns = read_turns(chats)
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    learned = F.when(F.col("learned"), F.col("text"))
    whole = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("n", line.alias("line"), learned.alias("learned")))).alias("all")
    )
    loss = F.array_join("all.learned", "")  # nulls are left out
    return whole.join(
        chats.select(F.col("conv_id").alias("_conv"), F.char_length("formatted").cast("long").alias("formatted_chars")),
        F.col("conv_id").eqNullSafe(F.col("_conv")),
    ).select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("all.line", ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
