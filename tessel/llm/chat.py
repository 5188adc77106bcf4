"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of typed parts. A visitor over the parts writes text with its control strings escaped and
a placeholder for each image, audio clip and document, and records the attachment's reference and the tokens that it
expands to. Text parts that meet are one text before it is escaped, so that no control string comes about where they
join. Turns are joined under a template that marks who speaks; the assistant's text, and no placeholder, is under the
loss mask.

Escaping is reversible: "<" and "|" with k backslashes between them get k + 1, so that no text holds a control string.
In roles "%" and line feeds are written as %25 and %0A too, since a line feed ends a role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Pixels of a patch's side, tokens for a second of audio and for a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text) -> F.Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text) -> F.Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role) -> F.Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role) -> F.Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def as_parts(text) -> F.Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _tokens(part) -> F.Column:
    """What an attachment expands to; 1 where its size is unknown."""
    patches = lambda c: F.ceil(part[c] / F.lit(PATCH))
    n = F.when(part["kind"] == "image", patches("width") * patches("height")).when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).when(part["kind"] == "document", part["pages"].cast("long") * PAGE_TOKENS)
    return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("long")


def _visited(parts) -> F.Column:
    """The parts as array<struct<written, text>>: texts that meet as one, escaped, and placeholders. An unknown kind counts as text."""
    run = lambda written, text: F.struct(written.alias("written"), F.lit(text).alias("text"))
    none = F.expr("cast(array() as array<struct<written:string,text:boolean>>)")
    closed = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], run(escape(acc["open"]), True)))

    def step(acc, part):
        mark = F.lit(None).cast("string")
        for kind, placeholder in PLACEHOLDERS.items():
            mark = F.when(part["kind"] == kind, F.lit(placeholder)).otherwise(mark)
        done = F.when(mark.isNull(), acc["done"]).otherwise(F.array_append(closed(acc), run(mark, False)))
        open_ = F.when(mark.isNull(), F.concat(acc["open"], F.coalesce(part["text"], F.lit("")))).otherwise(F.lit(""))
        return F.struct(done.alias("done"), open_.alias("open"))

    return F.aggregate(parts, F.struct(none.alias("done"), F.lit("").alias("open")), step, closed)


def _loss(runs, begin) -> F.Column:
    """The spans of the texts among the runs of a content that begins at begin."""
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)")

    def step(acc, run):
        end = acc["at"] + F.char_length(run["written"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(run["text"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(runs, F.struct(begin.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def formatted(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts array<PART>) -> (conv_id, n_turns, formatted, loss_spans, attachments), a row for each conversation.

    Turns go by turn, then role, then content; a null turn comes first, null roles and parts are empty, null parts
    of a list are left out. Repeated rows are repeated turns. loss_spans (start, end) count code points; each holds a
    stretch of text of an assistant turn between placeholders. attachments (turn_no, kind, ref, tokens) stand in the order of their
    placeholders. A null conv_id is a conversation like any other. An empty table gives an empty one; other columns
    are ignored. A conversation is one row of the result, and so is bounded by what a row can hold.
    """
    parts = F.filter(F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)")), lambda p: p.isNotNull())
    attached = F.transform(F.filter(parts, lambda p: p["kind"].isin(*PLACEHOLDERS)), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    role = F.coalesce("role", F.lit(""))
    each = turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        _visited(parts).alias("runs"),
        attached.alias("attached"),
    ).withColumn("content", F.array_join("runs.written", ""))
    tail = END + "\n"
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("content") + len(tail)
    each = each.withColumns({"no": F.row_number().over(order), "start": F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")})
    begin = F.col("start") + F.char_length("head")
    each = each.select(
        "conv_id",
        F.struct(
            "no",
            F.concat("head", "content", F.lit(tail)).alias("segment"),
            F.when(F.col("role") == "assistant", _loss(F.col("runs"), begin)).otherwise(F.expr("cast(array() as array<struct<start:long,end:long>>)")).alias("loss"),
            F.transform("attached", lambda a: F.struct((F.col("no") - 1).alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attached"),
        ).alias("t"),
    )
    out = each.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list("t")).alias("t"))
    return out.select("conv_id", "n_turns", F.array_join("t.segment", "").alias("formatted"), F.flatten("t.loss").alias("loss_spans"), F.flatten("t.attached").alias("attachments"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, content>>, loss_text, formatted_chars) from formatted() alone: texts unescaped, placeholders as they stand."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.size(F.split("formatted", r"<\|im_start\|>")))
    tail = len(END) + 1

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        skip = F.char_length(role) + 1
        text = F.substring(piece, skip + 1, F.char_length(piece) - skip - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("content"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what read_back() finds."""
    back = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
