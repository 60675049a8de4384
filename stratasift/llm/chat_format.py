"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor walks each turn's content parts in order. Text parts go through the template's
escape; image, audio and document parts become ordered placeholders, each recorded as an
attachment with its reference and the count of tokens it expands to. Turns are then joined
into one string a conversation, with the character spans that a training loss covers.

The template is `### Role: text </turn>` and a line feed. `#`, `<` and the backslash never
stand raw inside a role or text, so neither marker can be forged, and unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks. In texts `\` becomes `\\`, `#` becomes `\h`, `<` becomes `\l`; in roles `:` becomes `\c` too.
HEAD, MID, TAIL = "### ", ": ", " </turn>\n"
#: Part kinds and the default expansion: pixels along a side of an image token, audio tokens a second, tokens a document page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1000
#: Turn numbers joined in the first step; a longer conversation is joined from its blocks.
BLOCK = 256

PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Inverse of escape: double backslashes are split off first, so what is left of a backslash starts a code."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))), "\\")


def text_parts(text: Column) -> Column:
    """A plain message as one text part."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def visit(parts: Column) -> Column:
    """Parts to (body, attachments): the visitor. Null parts and unknown kinds add nothing; missing sizes count as one token."""
    whole = F.coalesce(parts, F.from_json(F.lit("[]"), PARTS_TYPE))
    known = F.filter(whole, lambda p: p.isNotNull() & p.kind.isin("text", "image", "audio", "document"))
    numbered = F.transform(known, lambda p, i: F.struct(i.cast("long").alias("at"), p.alias("part")))

    def tokens(p: Column) -> Column:
        image = F.ceil(p.width / IMAGE_PATCH) * F.ceil(p.height / IMAGE_PATCH)
        return F.coalesce(F.greatest(F.lit(1), F.when(p.kind == "image", image).when(p.kind == "audio", F.ceil(p.seconds * AUDIO_RATE)).otherwise(p.pages * PAGE_TOKENS)), F.lit(1)).cast("long")

    attached = F.filter(numbered, lambda x: x.part.kind != "text")
    attachments = F.transform(attached, lambda x, i: F.struct(i.cast("long").alias("number"), x.at.alias("at"), x.part.kind.alias("kind"), x.part.ref.alias("ref"), tokens(x.part).alias("tokens")))
    numbers = F.transform(attached, lambda x: x.at)
    body = F.transform(
        numbered,
        lambda x: F.when(x.part.kind == "text", escape(x.part.text)).otherwise(F.concat(F.lit("\\a"), x.part.kind, F.lit(" "), (F.array_position(numbers, x.at) - 1).cast("string"), F.lit(";"))),
    )
    return F.struct(F.array_join(body, "").alias("body"), attachments.alias("attachments"))


def format_conversations(turns: DataFrame, parts: Column | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans, attachments, n_expanded_tokens.

    turns has conv_id, turn, role and text (or content parts, given as a column of type
    PARTS_TYPE). Turns are ordered by turn, then role and body, so ties and repeated rows
    give one result; null turns come first, a null role or text counts as empty, rows of a
    null conv_id form a conversation of their own. loss_spans are (start, length) in code
    points of the formatted string, one for each turn of loss_role. Turns are joined in
    blocks of BLOCK consecutive turn numbers before whole conversations are, so that a long
    conversation is shuffled and sorted in pieces; turns of one number, or of none, share a
    piece. What meets at last is the conversation as one string, which is the result itself.
    Other columns are ignored.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), visit(parts if parts is not None else text_parts(F.col("text"))).alias("v"))
    head = F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(MID))
    t = t.select(
        "conv_id", "turn", F.floor(F.col("turn") / BLOCK).alias("block"),
        F.struct("turn", "role", F.col("v.body").alias("body"), F.concat(head, F.col("v.body"), F.lit(TAIL)).alias("piece"), F.length(head).cast("long").alias("lead"), F.col("v.attachments").alias("attachments")).alias("x"),
    )
    # Sums and joins over a block in one pass: an ordered list, then folds over it.
    blocks = t.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    blocks = blocks.select(
        "conv_id", "block", F.size("xs").cast("long").alias("n"),
        F.array_join(F.transform("xs", lambda x: x.piece), "").alias("formatted"),
        F.aggregate(
            "xs", F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
            lambda s, x: F.struct(
                (s.end + F.length(x.piece)).alias("end"),
                F.when(x.role == loss_role, F.concat(s.spans, F.array(F.struct((s.end + x.lead).alias("start"), F.length(x.body).cast("long").alias("length"))))).otherwise(s.spans).alias("spans"),
            ),
        ).alias("s"),
        F.flatten(F.transform("xs", lambda x: F.transform(x.attachments, lambda a: F.struct(x.turn.alias("turn"), a.number.alias("number"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens"))))).alias("attachments"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(-(2**62))).alias("block"), "formatted", "s", "attachments"))).alias("bs"))
    shifted = F.aggregate(
        "bs", F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<array<struct<start:long,length:long>>>").alias("spans")),
        lambda s, b: F.struct((s.end + b.s.end).alias("end"), F.concat(s.spans, F.array(F.transform(b.s.spans, lambda p: F.struct((p.start + s.end).alias("start"), p.length.alias("length"))))).alias("spans")),
    )
    attachments = F.flatten(F.transform("bs", lambda b: b.attachments))
    return whole.select(
        "conv_id", "n_turns", F.array_join(F.transform("bs", lambda b: b.formatted), "").alias("formatted"), F.flatten(shifted.spans).alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a.tokens).alias("n_expanded_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, " </turn>\n", -1)
    kept = F.slice(pieces, 1, F.size(pieces) - 1)
    # A raw "#" stands in the head only, and a role cannot hold it; the role ends at the first ": " after it.
    return F.transform(kept, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), MID, 1)).alias("role"), unescape(F.substr(p, F.locate(MID, p, len(HEAD) + 1) + len(MID))).alias("text")))
