"""Chat formatting with Spark expressions only.

A conversation becomes one string. Each run of turns by one role is

    <s>[ROLE]role[/ROLE]text[NEXT]text ... </s>

with [NEXT] between the texts of adjacent turns of the same role, so that merging them loses no boundary.
Control strings inside roles and texts get a backslash after their first character, and those that have
backslashes there already get one more; taking one away again restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, NEXT, CLOSE = "<s>[ROLE]", "[/ROLE]", "[NEXT]", "</s>"
#: Strings of this and of other common templates, after their bracket.
_CONTROL = r"/?(?:s>|ROLE\]|NEXT\]|INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def chat_format(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_col, formatted, mask: a row for each conversation.

    mask is the loss mask as run lengths, an array of (n_chars, loss) whose lengths add up to the string's;
    it covers the texts of loss_roles and nothing else. Null roles and texts count as empty, a null turn
    sorts first, turns alike sort by role and text, and repeated rows all stay. A null conversation is one
    conversation; other columns are ignored; an empty table gives an empty result. A conversation becomes one string, so
    all of it must fit into one task's memory (2 GB at most): groups without a conversation's bound, such as all null ones of a damaged table, must be split before.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = rows.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    df = df.withColumn("begins", begins)
    end = lambda j: F.coalesce(F.get(F.col("begins"), j + 1), F.size("turns"))
    runs = F.transform("begins", lambda b, j: F.struct(role_at(b).alias("role"), F.transform(F.slice("turns", b + 1, end(j) - b), lambda t: t["text"]).alias("texts")))
    df = df.select("conv", runs.alias("runs"))

    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def of_run(run: Column) -> Column:
        head = part(F.concat(F.lit(OPEN), escaped(run["role"]), F.lit(ROLE_END)), no)
        texts = F.transform(run["texts"], lambda x, k: F.array(part(F.when(k > 0, F.lit(NEXT)).otherwise(F.lit("")), no), part(escaped(x), run["role"].isin(*loss_roles))))
        return F.concat(F.array(head), F.flatten(texts), F.array(part(F.lit(CLOSE), no)))

    df = df.select("conv", F.filter(F.flatten(F.transform("runs", of_run)), lambda p: p["text"] != "").alias("parts"))
    mask = F.transform("parts", lambda p: F.struct(F.length(p["text"]).alias("n_chars"), p["loss"].alias("loss")))
    return df.select(F.col("conv").alias(conv_col), F.array_join(F.col("parts")["text"], "").alias("formatted"), mask.alias("mask"))


def chat_read(formatted: DataFrame, text_col: str = "formatted", mask_col: str = "mask") -> DataFrame:
    """formatted with turns (an array of role and text, as they were) and loss_text (the texts under the mask, joined), from the string and its mask alone."""
    quoted = lambda x: rf"\Q{x}\E"
    blocks = F.filter(F.split(text_col, quoted(CLOSE)), lambda b: b != "")

    def of_block(block: Column) -> Column:
        halves = F.split(block, quoted(ROLE_END), 2)
        role = unescaped(F.substring(halves[0], F.lit(len(OPEN) + 1), F.length(halves[0])))
        return F.transform(F.split(halves[1], quoted(NEXT)), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    # The parts that the mask counts are what lies between control strings; empty texts have none.
    cuts = f"(?<={quoted(ROLE_END)})|(?={quoted(NEXT)})|(?<={quoted(NEXT)})|(?={quoted(CLOSE)})|(?<={quoted(CLOSE)})"
    parts = F.filter(F.split(text_col, cuts), lambda p: p != "")
    lost = F.filter(F.arrays_zip(parts.alias("part"), F.col(mask_col).alias("m")), lambda z: z["m"]["loss"])
    whole = F.forall(F.arrays_zip(parts.alias("part"), F.col(mask_col).alias("m")), lambda z: F.length(z["part"]).eqNullSafe(z["m"]["n_chars"]))
    loss = F.when(whole, F.array_join(F.transform(lost, lambda z: unescaped(z["part"])), "")).otherwise(F.raise_error(F.lit("the loss mask does not fit its text")))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, of_block)), "loss_text": loss})
