r"""Chat formatting with a loss mask, in DataFrame functions only.

A conversation's turns are collected as structs and sorted; runs of one role are merged by array functions; each merged turn is

    <|im_start|>role<|im_head|>\ntext<|im_next|>text ...<|im_end|>\n

Texts and roles can't hold a control string: ``\`` is written ``\\`` and ``<|`` is written ``<\|``, which reading back undoes.
The mask lists the lengths of controls and of what stands between them by turns, so it covers the whole string; each assistant
text counts for the loss, and nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, HEAD, NEXT, END = "<|im_start|>", "<|im_head|>\n", "<|im_next|>", "<|im_end|>\n"
_CONTROL = r"<\|im_start\|>|<\|im_head\|>\n|<\|im_next\|>|<\|im_end\|>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """For each conversation: conv's column, ``formatted`` and ``mask`` (array of (chars int, loss boolean), in code points).

    Null roles and texts are empty ones. Turns of equal number go by role, then text; null numbers come first. Rows that repeat are turns of
    their own. A null conversation is one of its own. No row: no row. A conversation becomes one string, so it must fit one row.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(conv).alias("__conv")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    rows = rows.withColumn("starts", F.filter(at, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))

    def run(start: Column, k: Column) -> Column:
        length = F.coalesce(F.get("starts", k + 1), F.size("turns")) - start
        return F.struct(F.get("turns", start)["role"].alias("role"), F.transform(F.slice("turns", start + 1, length), lambda t: escaped(t["text"])).alias("texts"))

    rows = rows.withColumn("runs", F.transform("starts", run))
    whole = F.array_join(F.transform("runs", lambda r: F.concat(F.lit(START), escaped(r["role"]), F.lit(HEAD), F.array_join(r["texts"], NEXT), F.lit(END))), "")

    def piece(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))

    no = F.lit(False)

    def mask(r: Column) -> Column:
        head = F.array(piece(F.lit(len(START)), no), piece(F.length(escaped(r["role"])), no))
        body = F.flatten(F.transform(r["texts"], lambda t, i: F.array(piece(F.when(i == 0, len(HEAD)).otherwise(len(NEXT)), no), piece(F.length(t), r["role"] == learned))))
        return F.concat(head, body, F.array(piece(F.lit(len(END)), no), piece(F.lit(0), no)))

    return rows.select(F.col("__conv").alias(conv), whole.alias("formatted"), F.flatten(F.transform("runs", mask)).alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats (as ``formatted`` gives them) with ``turns``, an array of (role, text), and ``learned``, the texts under the mask: from
    the string
    and its mask alone."""
    parts = chats.withColumn("__pieces", F.split("formatted", _CONTROL, -1))
    inside = F.split(F.col("formatted"), r"<\|im_start\|>", -1)

    def turn(s: Column) -> Column:
        cut = F.split(s, r"<\|im_head\|>\n", -1)
        body = F.regexp_replace(F.get(cut, F.lit(1)), r"<\|im_end\|>\n\z", "")
        return F.transform(F.split(body, r"<\|im_next\|>", -1), lambda t: F.struct(unescaped(F.get(cut, F.lit(0))).alias("role"), unescaped(t).alias("text")))

    turns = F.flatten(F.transform(F.slice(inside, 2, F.greatest(F.size(inside) - 1, F.lit(0))), turn))
    under = F.filter("__pieces", lambda p, i: (i > 0) & F.coalesce(F.get("mask", 2 * i - 1)["loss"], F.lit(False)))
    return parts.withColumn("turns", turns).withColumn("learned", F.transform(under, unescaped)).drop("__pieces")
