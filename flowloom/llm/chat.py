"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and its
text alone is trainable. A conversation that does not end with an assistant turn gives one
more example without a trainable part, so that the output holds every turn.

A turn is written ``### role: text</turn>`` and a line feed. Inside texts and roles a
backslash becomes ``\\\\``, ``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\t``; inside roles
a colon becomes ``\\c``. So no text can contain a marker, and reading left to right undoes it.

Edge cases: a null or empty text is an empty turn; a null role is an empty role; turns with
equal numbers are ordered by role, then text; null turn numbers come first; repeated rows are
turns of their own; rows with a null conversation id form one conversation; other columns
are ignored; an empty table gives an empty result. A conversation is the unit of the output
(its examples hold all of it), so it has to fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and what stands for them inside a text, applied in this order.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: The role whose texts are trained on.
TRAINED = "assistant"


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, written in pairs:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, pairs=ROLE_ESCAPES) -> Column:
    """Undo :func:`escape`: doubled backslashes split the text, the other escapes sit between."""

    def part(x: Column) -> Column:
        for plain, written in pairs[1:]:
            x = F.replace(x, F.lit(written), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Examples of all conversations (columns conv_id, turn, role, text).

    Returns conv_id, example (1, 2, ... in the conversation), formatted, loss_start (code
    points before the trainable text), loss_chars (0 where nothing is trained), is_last.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    written = F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(MIDDLE)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    last = F.size("written")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("written", i)["role"] == TRAINED) | (i == last))
    examples = whole.select("conv_id", written.alias("written")).select("conv_id", "written", F.posexplode(ends).alias("nth", "end"))
    reply = F.element_at("written", F.col("end"))
    before = F.array_join(
        F.transform(F.slice("written", F.lit(1), F.col("end") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""
    )
    trained = reply["role"] == TRAINED
    return examples.select(
        "conv_id",
        (F.col("nth") + 1).alias("example"),
        F.concat(before, reply["head"], reply["body"], F.lit(CLOSE)).alias("formatted"),
        F.when(trained, F.length(before) + F.length(reply["head"])).otherwise(0).cast("long").alias("loss_start"),
        F.when(trained, F.length(reply["body"])).otherwise(0).cast("long").alias("loss_chars"),
        (F.col("end") == last).alias("is_last"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, an array of (role, text), read by its markers alone."""
    parts = F.split(formatted, CLOSE, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, MIDDLE, 1)
        return F.struct(
            unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(part, F.length(role) + len(MIDDLE) + 1)).alias("text"),
        )

    return F.transform(parts, turn)


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), chars.cast("int")))
