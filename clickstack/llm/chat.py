"""Chat formatting of typed content parts, in DataFrame operations only.

A message is a list of typed parts. A visitor turns every part into text: a text part into its
escaped text, an image, audio or document part into a numbered placeholder. Placeholders are numbered in
conversation order; each records its attachment reference and the tokens it stands for once expanded.

Template of a turn: ``<|role|>`` text ``<|end|>``. Control strings inside texts and roles are
taken apart by a backslash behind their first character, and a backslash is doubled, so formatting can be
undone exactly. The loss mask is one span per assistant turn.

A conversation becomes one string, so it is gathered in one row; turns are formatted before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of this and of common chat templates, by their first character.
CONTROL = r"(<(?=/?s>|\||/?SYS>|</?SYS>)|\[(?=/?INST\])|\\)"
END = "<|end|>"
#: Tokens that an attachment expands to: per image, per second of audio, per page of a document.
EXPANDED = {"image": 576, "audio": 25, "document": 800}
PART = "struct<type:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role lies between bars, so bars are taken apart too."""
    return F.regexp_replace(role, r"([|<\[\\])", r"$1\\")


def visit(part: Column, number: Column) -> Column:
    """The text of one part; ``number`` counts the attachments before it in the conversation."""
    kind = F.lower(part["type"])
    placeholder = F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))
    return F.when(kind.isin(*EXPANDED), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def expanded_tokens(part: Column) -> Column:
    """Tokens of an attachment: its units (tiles, seconds, pages; at least one) times the tokens of a unit."""
    units = F.ceil(F.greatest(F.coalesce(part["units"], F.lit(1.0)), F.lit(1.0)))
    per = F.create_map(*[F.lit(x) for pair in EXPANDED.items() for x in pair])
    return (units * F.try_element_at(per, F.lower(part["type"]))).cast("long")


def is_attachment(part: Column) -> Column:
    return F.coalesce(F.lower(part["type"]).isin(*EXPANDED), F.lit(False))


def format_conversations(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, turn_lengths, loss_spans, attachments, attachment_tokens`` per conversation.

    ``messages(conv_id, turn, role, parts)``; rows go by turn, then role, then parts; null turns first.
    ``loss_spans`` are (turn number, start, end) code point offsets in ``formatted``, ``turn_lengths`` the
    code points of each turn. ``attachments`` lists (number, type, ref, tokens) in order.

    Null roles, parts and texts count as empty; a part of unknown type counts as text. Repeated rows are
    turns of their own; null conversation ids form one conversation. An empty table gives an empty result."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    rows = messages.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("own", F.size(F.filter("parts", is_attachment)).cast("long"))
    order = [F.col("turn").asc_nulls_first(), "role", F.to_json("parts")]
    ahead = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("own").over(ahead), F.lit(0)))
    nth = lambda p, i: F.col("before") + F.size(F.filter(F.slice(F.col("parts"), 1, i), is_attachment))
    # Turns without attachments, nearly all, skip the counting.
    flat = F.when(F.col("own") == 0, F.transform("parts", lambda p: visit(p, F.lit(0)))).otherwise(
        F.transform("parts", lambda p, i: visit(p, nth(p, i))))
    found = F.when(F.col("own") > 0, F.filter(F.transform("parts", lambda p, i: F.when(is_attachment(p), F.struct(
        nth(p, i).cast("long").alias("number"), F.lower(p["type"]).alias("type"), p["ref"].alias("ref"),
        expanded_tokens(p).alias("tokens")))), lambda a: a.isNotNull()))
    rows = rows.select(
        "conv_id", "turn", "role", F.to_json("parts").alias("tie"), F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>")).alias("head"),
        F.array_join(flat, "").alias("body"), found.alias("found"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("chars", F.length("piece").cast("long"))
    so_far = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    rows = rows.withColumn("number", F.row_number().over(so_far)).withColumn(
        "start", F.sum("chars").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars"))
    begin = F.col("start") + F.length("head")
    span = F.when(F.col("role").isin(*trained_roles), F.struct(
        F.col("number").alias("turn_number"), begin.alias("start"), (begin + F.length("body")).alias("end")))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "number", "piece", "chars", span.alias("span"), "found"))).alias("turns"))
    attachments = F.flatten(F.filter(F.col("turns.found"), lambda a: a.isNotNull()))
    return gathered.select(
        "conv_id", F.array_join("turns.piece", "").alias("formatted"), F.col("turns.chars").alias("turn_lengths"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(F.transform(attachments, lambda a: a["tokens"]), F.lit(0).cast("long"), lambda a, b: a + b).alias("attachment_tokens"))


def read_back(formatted: DataFrame, *also: str) -> DataFrame:
    """Undo the template: ``conv_id, turns`` (role, text) and ``loss_texts``, from ``formatted`` and its
    spans; columns named in ``also`` are passed on.

    The string is split behind every end mark; spans are cut out of the turn they lie in."""
    pieces = F.filter(F.split(F.col("formatted"), r"(?<=<\|end\|>)"), lambda x: x != "")
    turn = F.transform("pieces", lambda x: F.struct(
        unescape(F.regexp_extract(x, r"(?s)^<\|(.*?)\|>", 1)).alias("role"),
        unescape(F.regexp_extract(x, r"(?s)^<\|.*?\|>(.*)<\|end\|>$", 1)).alias("text")))
    # Where each turn starts: running sums by one pass over the lengths.
    spans = F.transform("loss_spans", lambda s: F.struct(
        F.element_at("pieces", s["turn_number"]).alias("piece"),
        s["end"].alias("end"), s["start"].alias("start")))
    # A span ends where its turn's end mark begins, so its place is counted from the turn's end.
    cut = F.transform(spans, lambda s: unescape(F.substr(
        s["piece"], (F.length(s["piece"]) - len(END) - (s["end"] - s["start"]) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("pieces", pieces).select("conv_id", turn.alias("turns"), cut.alias("loss_texts"), *also)


def text_messages(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as messages of one text part each."""
    part = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))).cast(f"array<{PART}>")
    return conversations.select("conv_id", "turn", "role", part.alias("parts"))
