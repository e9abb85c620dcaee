"""Operator 6: chat formatting by prefix-target expansion. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
"""Every turn is BEGIN role newline text END newline."""


def escaped(text: Column) -> Column:
    r"""Without "<|": a backslash is put before the bar of each "<|", "<\|", "<\\|" and so on, which unescaped() takes away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """Without "<|" and newlines, by percent signs."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One example for each turn of the target role: conv_id, target_turn (number in the conversation, from 0), text, loss_start, loss_chars.

    text holds all turns up to that one; only loss_chars characters from loss_start (from 0) are trainable, the target's
    own escaped text. A conversation that ends otherwise has one more example with all its turns, whose target_turn is
    null and which trains nothing, so no turn is lost. Each conversation is one row of its own text; the examples are
    prefixes of that, so the shuffle carries every turn once.

    Rows of a conversation stand by turn, then role and text; null turns first. Null texts and roles are empty. A null
    conversation id is a conversation. Repeated rows are turns of their own. Empty table: no rows. Other columns are not
    read. Lengths are running sums over the turns. A conversation's whole text is one value, as the last example of it is,
    so it can have at most 2 GB.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    head, body = F.concat(F.lit(BEGIN), escaped_role(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text", (F.col("role") == target).alias("trains"), F.length(head).alias("head"), F.length(body).alias("chars"), F.concat(head, body, F.lit(END + "\n")).alias("piece"))
    end = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.select("conv_id", "trains", "head", "chars", "piece", (F.row_number().over(order) - 1).alias("i"), end.alias("end"))
    spans = F.struct("i", "trains", (F.col("end") - F.length("piece") + F.col("head")).alias("start"), "chars", "end")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "piece"))).alias("pieces"), F.collect_list(F.when(F.col("trains"), spans)).alias("examples"), F.max(F.when(~F.col("trains"), spans)).alias("other"), F.max("i").alias("last"))
    # the last turn of a conversation that ends otherwise
    rest = F.filter(F.array("other"), lambda x: x["i"] == F.col("last"))
    whole = whole.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("full"), F.concat("examples", rest).alias("examples"))
    return whole.select("conv_id", "full", F.explode("examples").alias("x")).select(
        "conv_id",
        F.when(F.col("x.trains"), F.col("x.i")).alias("target_turn"),
        F.substring("full", F.lit(1), F.col("x.end")).alias("text"),
        F.col("x.start").alias("loss_start"),
        F.when(F.col("x.trains"), F.col("x.chars")).otherwise(0).alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns come from the longest example, the loss from each example's own span, both unescaped.
    """
    loss = unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))
    by_conv = examples.groupBy("conv_id").agg(
        F.max(F.struct(F.length("text").alias("n"), F.col("text").alias("text")))["text"].alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("target_turn").isNotNull(), F.struct("target_turn", loss.alias("loss"))))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    turns = F.filter(F.split("longest", r"\Q" + END + r"\E\n"), lambda x: x != "")
    body = F.transform(turns, lambda x: F.concat(unescaped_role(F.substring(x, F.lit(len(BEGIN) + 1), F.locate("\n", x) - len(BEGIN) - 1)), F.lit("\n"), unescaped(F.substr(x, F.locate("\n", x) + 1)), F.lit("\n")))
    trained = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return by_conv.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(body, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )
