"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

A turn is written as  <s>role⏎text </s>⏎  . Inside roles and texts a backslash is put before each <s> and </s> (and before
the backslashes that precede one), so control strings in texts never look like marks and come back exactly. The blank
before the closing mark keeps a backslash at the end of a text away from it.

Example k of a conversation is everything up to and including its k-th assistant turn; only that reply is trainable. What
follows the last reply is an example too, with nothing to train, so that no turn is lost. Contexts are written out in
full, so the output of a conversation grows with the square of its turns: that is the method, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", " </s>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*</?s>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*</?s>)", "$1")


def _escape_role(role: Column) -> Column:
    """Roles also keep their line to themselves: a backslash becomes \\b, a line end \\n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    """Every backslash begins a pair, so pairs of the one kind can be replaced before those of the other."""
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def examples(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, example, last, formatted, loss_begin, loss_end), one row for each assistant turn and for a rest.

    `formatted` is the example, `loss_begin` and `loss_end` the code points of it that are trainable (equal in a rest);
    `last` marks the example that holds the whole conversation. Turns are ordered by `turn` (null first), equal ones by
    role and text; equal rows are turns of their own. Null roles and texts count as empty; a null conversation is one
    conversation. An empty table has no examples. Other columns are not looked at.
    """
    t = rows.select(F.col(conversation).alias("_conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("head", F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")))
    t = t.withColumn("body", escape(F.col("text")))
    talks = t.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    talks = talks.select("_conv", "turns", F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("whole"),
                         F.transform("turns", lambda x: F.struct(
                             F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"), (x["role"] == ASSISTANT).alias("reply"))).alias("sizes"))
    # ends of turns, by one pass that carries (position, list)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int,end:int,reply:boolean>>").alias("list"))
    walked = F.aggregate("sizes", start, lambda a, x: F.struct(
        (a["at"] + x["head"] + x["body"] + len(CLOSE)).alias("at"),
        F.concat(a["list"], F.array(F.struct(
            (a["at"] + x["head"]).alias("begin"), (a["at"] + x["head"] + x["body"]).alias("stop"),
            (a["at"] + x["head"] + x["body"] + len(CLOSE)).alias("end"), x["reply"].alias("reply")))).alias("list")), lambda a: a["list"])
    marked = talks.select("_conv", "whole", walked.alias("ends"))
    chosen = marked.withColumn("n", F.size("ends")).withColumn(
        "picked", F.filter("ends", lambda x, i: x["reply"] | (i == F.col("n") - 1)))
    out = chosen.select("_conv", "whole", F.size("picked").alias("of"), F.posexplode("picked").alias("example", "x"))
    return out.select(
        F.col("_conv").alias(conversation), "example", (F.col("example") == F.col("of") - 1).alias("last"),
        F.substring("whole", F.lit(1), F.col("x.end")).alias("formatted"), F.col("x.begin").alias("loss_begin"),
        F.when(F.col("x.reply"), F.col("x.stop")).otherwise(F.col("x.begin")).alias("loss_end"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted example holds, read back from its marks."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        _unescape_role(F.substring(F.substring_index(p, "\n", 1), F.lit(len(OPEN) + 1), F.length(p))).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def trained(formatted: Column, begin: Column, end: Column) -> Column:
    """The text under the loss mask, without escapes."""
    return unescape(F.substring(formatted, begin + 1, end - begin))


def digests(expanded: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation what its examples hold: turns, trained text, and characters written."""
    said = F.when(F.col("last"), turns_of(F.col("formatted")))
    small = expanded.select(
        F.col(conversation).alias("_conv"), "example", trained(F.col("formatted"), F.col("loss_begin"), F.col("loss_end")).alias("loss"),
        F.length("formatted").alias("size"), F.size(said).alias("n"),
        F.array_join(F.transform(said, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"))
    out = small.groupBy("_conv").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("said").alias("_said"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("_loss"),
        F.sum("size").cast("long").alias("formatted_chars"))
    return out.select(F.col("_conv").alias(conversation), "n_turns", F.sha2(F.col("_said").cast("binary"), 256).alias("turns_sha256"),
                      F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
                      "formatted_chars")
