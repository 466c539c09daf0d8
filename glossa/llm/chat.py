"""Relational chat formatting: sorted turn structs, runs of one role merged into blocks, Spark expressions only.

The template of a conversation is ``<s>`` followed by blocks
``[ROLE]role[/ROLE]text[NEXT]text...</s>``: neighbouring turns of one role
share a block, ``[NEXT]`` marks where one ends. Control strings inside roles
and texts are escaped by a backslash after their first character; backslashes
of the input are doubled first, so unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
BEGIN, END, ROLE, ROLE_END, NEXT = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[NEXT]"
CONTROL = r"/?s>|/?ROLE\]|/?NEXT\]|/?INST\]|\|[a-z_]{1,32}\|>"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])({CONTROL})", r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, rf"([<\[])\\({CONTROL})", "$1$2"), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): conv_id, formatted, segments.

    ``segments`` cuts ``formatted`` into structs (text, loss); loss marks the
    texts of ``loss_role``, which is the loss mask. Turns are sorted by turn,
    then role, then text (ties and repeated rows all stay; null turn first).
    Null role or text: empty. Null conv_id: one conversation. Empty table: no
    rows. Other columns are ignored. A conversation is one output value, so
    its turns meet in one task.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.element_at("turns", i + 1)["role"] != F.element_at("turns", F.greatest(i, F.lit(1)))["role"]))
    conv = conv.withColumn("starts", starts)
    stops = F.concat(F.slice("starts", 2, F.size("starts")), F.array(n))
    conv = conv.withColumn("spans", F.arrays_zip("starts", stops.alias("stops")))
    blocks = F.transform(
        "spans",
        lambda s: F.struct(
            F.element_at("turns", s["starts"] + 1)["role"].alias("role"),
            F.transform(F.slice("turns", s["starts"] + 1, s["stops"] - s["starts"]), lambda t: t["text"]).alias("texts"),
        ),
    )
    conv = conv.select("conv_id", blocks.alias("blocks"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            piece(F.when(i == 0, F.concat(F.lit(ROLE), escape(b["role"]), F.lit(ROLE_END))).otherwise(F.lit(NEXT)), no),
                            piece(escape(t), b["role"] == loss_role),
                        ),
                    )
                ),
                F.array(piece(F.lit(END), no)),
            ),
        )
    )
    conv = conv.select("conv_id", F.concat(F.array(piece(F.lit(BEGIN), no)), segments).alias("segments"))
    return conv.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were."""
    body = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    blocks = F.filter(F.split(body, END), lambda b: b != "")

    def turns(b: Column) -> Column:
        # control strings are escaped inside roles, so the first one ends the role
        parts = F.split(b, r"\[/ROLE\]", 2)
        role = unescape(F.substring(parts[0], len(ROLE) + 1, 2**31 - 1))
        return F.transform(F.split(parts[1], r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))
