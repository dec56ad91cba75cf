"""Chat formatting by prefix-target expansion, with built-in Spark expressions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and its reply alone is trainable.  A conversation whose last turn is
not an assistant's gets one more example without a trainable part, so that no
turn is lost.

Defined cases: a null text or role is empty; a null conv_id is a conversation
of its own; turns are ordered by turn (null last), then role, then text, so
repeated rows stay and reruns agree; control strings inside texts and roles are
escaped by one backslash and come back unchanged; an empty table gives none.
Columns other than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """Without any ``<|``: one backslash is put before the bar, after those already there."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    """A role ends at the first line break, so its own ones are written as %0A."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chat_examples(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example_no, text, loss_start, loss_length, is_last.

    ``loss_start`` counts code points from 0; ``loss_length`` is null where
    nothing is trainable.  ``is_last`` marks the example that holds all turns.
    The turns of a conversation meet in one row, since each example contains
    all turns before it; the number of rows is the number of replies.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    turn = F.struct(
        F.col("turn").isNull().alias("unnumbered"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    ordered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segments = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit(START), _escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END), F.lit("\n")
        ),
    )
    wanted = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.element_at("turns", i)["role"] == ASSISTANT) | (i == F.size("turns")),
    )
    rows = ordered.select(
        "conv_id",
        segments.alias("segments"),
        F.transform(
            wanted,
            lambda i: F.struct(
                i.alias("upto"),
                F.when(
                    F.element_at("turns", i)["role"] == ASSISTANT, F.length(escaped(F.element_at("turns", i)["text"]))
                ).alias("loss_length"),
            ),
        ).alias("wanted"),
    ).select("conv_id", "segments", F.posexplode("wanted").alias("example_no", "target"))
    tail = len(END) + 1
    text = F.array_join(F.slice("segments", F.lit(1), F.col("target.upto")), "")
    return rows.select(
        "conv_id",
        "example_no",
        text.alias("text"),
        F.col("target.loss_length").alias("loss_length"),
        (F.col("target.upto") == F.size("segments")).alias("is_last"),
    ).select(
        "conv_id",
        "example_no",
        "text",
        (F.length("text") - tail - F.col("loss_length")).alias("loss_start"),
        "loss_length",
        "is_last",
    )


def parsed_turns(text: Column) -> Column:
    """The turns of a formatted example as an array of (role, text)."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p != "")
    bodies = F.transform(parts, lambda p: F.substring(p, len(START) + 1, 2147483647))
    return F.transform(
        bodies,
        lambda p: F.struct(
            _unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
        ),
    )


def trainable_text(text: Column, start: Column, length: Column) -> Column:
    """What is under the loss mask, unescaped; empty where nothing is."""
    return F.when(length > 0, unescaped(F.substr(text, start + 1, length))).otherwise("")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what a reader of the examples finds: turns, replies and sizes."""
    whole = F.when(F.col("is_last"), parsed_turns(F.col("text")))
    rows = examples.select(
        "conv_id",
        "example_no",
        F.length("text").cast("long").alias("chars"),
        trainable_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        whole.alias("turns"),
    ).select(
        "conv_id",
        "example_no",
        "chars",
        "loss",
        F.when(F.col("turns").isNotNull(), F.size("turns")).cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(
                F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ),
            256,
        ).alias("turns_sha256"),
    )
    found = rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("example_no", "loss"))), lambda x: x["loss"]), ""
        ).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
