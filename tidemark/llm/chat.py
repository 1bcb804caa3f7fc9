"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example: all turns before it as context, then the turn itself, whose text alone is
trainable.  Turns after the last reply make a further example that trains nothing, so that the output holds the whole conversation.

A turn is written ``### role: text </turn>`` and a line break.  In texts ``\\``, ``#`` and ``<`` are written ``\\b``, ``\\h`` and
``\\l`` (in roles also ``:`` as ``\\c``): no mark can occur within a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
#: Written forms of the reserved characters; the escape character itself is first when writing, last when reading.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]


def escape(c: Column, role: bool = False) -> Column:
    for plain, written in ESCAPES if role else ESCAPES[:-1]:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for plain, written in reversed(ESCAPES if role else ESCAPES[:-1]):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars) from rows (conv_id, turn, role, text).

    ``example`` is the place of the example's last turn in its conversation; the loss mask covers the characters
    (code points) from ``loss_start`` on, none in a remainder.  Turns go by (turn, role, text), so ties and repeated rows have a
    fixed order; null texts and roles are as empty; null conv_ids form one conversation; no rows give no examples.  Other
    columns are ignored.  One shuffle by conversation; a conversation's turns must fit in a task, since
    its last example holds them all.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(AFTER_ROLE))
    written = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(head(t), escape(t["text"]), F.lit(CLOSE)).alias("s"), F.length(head(t)).alias("head"),
                F.length(escape(t["text"])).alias("n"), (t["role"] == "assistant").alias("reply"),
            ),
        ).alias("w"),
    )
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i)["reply"] | (i == F.size("w") - 1))
    each = written.select("conv_id", "w", F.explode(at).alias("example"))
    last = F.get("w", F.col("example"))
    formatted = F.array_join(F.transform(F.slice("w", F.lit(1), F.col("example") + 1), lambda t: t["s"]), "")
    return each.select("conv_id", F.col("example").cast("long").alias("example"), formatted.alias("formatted"), last.alias("last")).select(
        "conv_id", "example", "formatted",
        (F.length("formatted") - F.length(F.col("last.s")) + F.col("last.head")).cast("long").alias("loss_start"),
        F.when(F.col("last.reply"), F.col("last.n")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars): the turns and the trained text of each conversation, out of its examples."""
    reply = unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_chars as int))"))
    own = examples.select("conv_id", "example", "formatted", reply.alias("reply"))
    joined = own.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"), F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.filter(F.split("all", CLOSE), lambda s: s != "")
    role = lambda s: F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), ":", 1)
    text = lambda s: F.substr(s, F.length(role(s)) + len(OPEN) + len(AFTER_ROLE) + 1)
    turns = F.transform(parts, lambda s: F.struct(unescape(role(s), role=True).alias("role"), unescape(text(s)).alias("text")))
    return joined.select(
        "conv_id", turns.alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss_text"),
        "formatted_chars",
    )
