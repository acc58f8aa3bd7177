r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn of a conversation becomes an example of its own: all turns up
to and with it in one text, of which only that reply is trainable (``loss_start`` to
``loss_end``, in code points). A conversation that does not end with a reply, or has
none, gets one more example without a trainable span, so that no turn is lost.

The template: ``<s>`` opens a turn and ``</s>`` closes it; the role stands in its
first line; turns that are not replies are held in ``[INST] `` and `` [/INST]``.
Texts and roles are escaped reversibly: ``\`` is doubled, and a control string gets
a ``\`` after its first character, so none occurs within a text.

Cases: null texts and roles count as empty; turns are ordered by turn, then role,
then text (nulls first), so repeated rows stay repeated; rows with a null
conversation id form one conversation; other columns are ignored. Each example
holds its whole prefix: the output grows with the square of a conversation's length
because the method asks for it, one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What opens and closes turns and instructions.
CONTROL = (r"<s>", r"</s>", r"[INST]", r"[/INST]")
_CONTROL_RE = r"([<\[])(/?(?:s>|INST\]))"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """text without control strings; unescape() gives it back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_RE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As escape(), and with a backslash before each line feed."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def render_head(role: Column) -> Column:
    """What stands before a turn's text."""
    return F.concat(F.lit("<s>"), escape_role(role), F.lit("\n"), F.when(role == TARGET_ROLE, "").otherwise("[INST] "))


def render_tail(role: Column) -> Column:
    return F.when(role == TARGET_ROLE, "</s>").otherwise(" [/INST]</s>")


def format_examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conversation id, target, formatted, loss_start, loss_end): an example for each reply.

    target is the 0-based number of the trainable turn; the example of what follows the
    last reply has the number of turns there, and nulls for its loss span.
    """
    if conv_col.lower() in ("target", "formatted", "loss_start", "loss_end"):
        raise ValueError(f"the id column has a result column's name: {conv_col}")
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col), F.col(turn_col).alias("__turn"), role.alias("__role"), text.alias("__text"))
    rows = rows.withColumns(
        {"__head": render_head(F.col("__role")), "__body": escape(F.col("__text")), "__tail": render_tail(F.col("__role"))}
    )
    # where each turn ends in the whole text: a running sum in the order of the turns
    so_far = Window.partitionBy(conv_col).orderBy("__turn", "__role", "__text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("__head") + F.length("__body") + F.length("__tail")
    rows = rows.withColumn("__stop", F.sum(size).over(so_far).cast("int"))
    row = F.struct(
        "__turn",
        "__role",
        "__text",
        "__stop",
        (F.col("__stop") - F.length("__tail") - F.length("__body")).alias("start"),
        (F.col("__stop") - F.length("__tail")).alias("end"),
        F.concat("__head", "__body", "__tail").alias("piece"),
    )
    convs = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    convs = convs.select(
        conv_col,
        F.transform("rows", lambda r: r["__role"]).alias("roles"),
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("whole"),
        F.transform("rows", lambda r: F.struct(r["start"], r["end"], r["__stop"].alias("stop"))).alias("spans"),
    )
    n = F.size("roles")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("roles", i) == TARGET_ROLE)
    ends = F.when(F.get("roles", n - 1) == TARGET_ROLE, F.array().cast("array<int>")).otherwise(F.array(n))
    examples = convs.select(conv_col, "whole", "spans", n.alias("n"), F.explode(F.concat(targets, ends)).alias("target"))
    span = F.get("spans", F.least(F.col("target"), F.col("n") - 1))
    trained = F.col("target") < F.col("n")
    return examples.select(
        conv_col,
        "target",
        F.substring(F.col("whole"), F.lit(1), span["stop"]).alias("formatted"),
        F.when(trained, span["start"]).alias("loss_start"),
        F.when(trained, span["end"]).alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    pieces = F.split(formatted, "</s>")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    head = r"(?s)^<s>((?:[^\\\n]|\\.)*)\n"
    body = lambda p: F.substring(p, F.length(F.regexp_extract(p, head, 0)) + 1, F.length(p))

    def turn(p: Column) -> Column:
        role = unescape(F.regexp_extract(p, head, 1))
        text = F.when(role == TARGET_ROLE, body(p)).otherwise(F.substring(body(p), F.lit(8), F.length(body(p)) - 15))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_conversations(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation id, turns, replies, formatted_chars), read back from examples.

    turns come from the longest example, replies are the unescaped texts under the loss
    masks in order of their targets, and formatted_chars is the total of all examples.
    """
    masked = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    got = examples.select(
        conv_col,
        "target",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), F.struct("target", unescape(masked).alias("reply"))).alias("reply"),
        "formatted",
    )
    return (
        got.groupBy(conv_col)
        .agg(
            F.max_by("formatted", "target").alias("formatted"),
            F.sort_array(F.collect_list("reply")).alias("replies"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(conv_col, parse_turns(F.col("formatted")).alias("turns"), F.transform("replies", lambda r: r["reply"]).alias("replies"), "formatted_chars")
    )
