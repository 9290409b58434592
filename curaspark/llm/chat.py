"""Chat formatting with DataFrame expressions only.

Every turn row becomes ``### role: text``; adjacent turns of one role share a block, joined by ``<next/>``; a
block ends with ``</turn>`` and a newline. Control strings inside roles and texts are escaped with backslash
codes, so ``parse_chats`` reads the exact turns back.

Defined results: turns are ordered by (turn, role, text), nulls first, so ties and repeated rows stay, in a
fixed order; a null role or text is empty; an empty table gives an empty result; a null conversation id is one
conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, NEXT, END = "### ", ": ", "<next/>", "</turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Reversible: a backslash becomes a code, then each control string loses its first character to one."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, "#(?=##)", r"\\h")
    text = F.replace(text, F.lit("</turn>"), F.lit("\\l/turn>"))
    return F.replace(text, F.lit(NEXT), F.lit("\\lnext/>"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(F.replace(text, F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def format_chats(turns: DataFrame, *, conv="conv_id", turn="turn", role="role", text="text", trained=TRAINED_ROLE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans array<struct<start,length>> in code points."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.try_element_at("turns", F.greatest(i, F.lit(1)).cast("int"))["role"] != t["role"])
        closes = (i == F.size("turns") - 1) | (F.try_element_at("turns", (i + 2).cast("int"))["role"] != t["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(SEP))).otherwise(F.lit(NEXT)).alias("before"),
            escape(t["text"]).alias("body"),
            F.when(F.coalesce(closes, F.lit(True)), F.lit(END)).otherwise(F.lit("")).alias("after"),
            (t["role"] == trained).alias("trained"),
        )

    chats = chats.select("conv_id", "turns", F.transform("turns", piece).alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        body = acc["at"] + F.length(p["before"])
        length = F.length(p["body"]).cast("long")
        span = F.array(F.struct(body.alias("start"), length.alias("length")))
        return F.struct(
            (body + length + F.length(p["after"])).alias("at"),
            F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        F.aggregate("pieces", start, add)["spans"].alias("loss_spans"),
    )


def parse_chats(formatted: Column) -> Column:
    """The turns, array<struct<role,text>>, read back from a formatted conversation."""

    def block(b: Column) -> Column:
        body = F.substr(b, F.lit(len(HEAD) + 1))
        at = F.locate(SEP, body)
        role = unescape(F.substr(body, F.lit(1), at - 1))
        texts = F.split(F.substr(body, at + len(SEP)), NEXT, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, END, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
