"""Chat formatting over typed content parts, with a reversible template.

A turn is a role and an ordered array of parts: text, image, audio or document.
A visitor with one case for each kind flattens the parts: text is escaped, any
other part becomes its kind's placeholder, its reference goes to the list of
attachments in order (the n-th placeholder is the n-th attachment) and its size
to the count of tokens that the placeholder stands for.

    ### role: content</turn>

Control strings inside texts and roles are escaped with a backslash, so that
splitting the output at the turn's end gives the turns back exactly. The loss
mask covers the contents of assistant turns, without header and end mark.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "### "
ROLE_END = ": "
END = "</turn>"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
#: What each control string inside a text becomes. The backslash itself is doubled first.
ESCAPES = {"###": "\\h", "</turn>": "\\t", "<image>": "\\i", "<audio>": "\\a", "<document>": "\\d"}
#: In roles these count as control strings, too.
ROLE_ESCAPES = ESCAPES | {":": "\\c", "\n": "\\n"}

#: Tokens that a placeholder stands for: image patches of so many pixels a side, audio frames a second, and a document's tokens a page.
PATCH_PIXELS = 28
AUDIO_FRAMES = 25
PAGE_TOKENS = 1024
#: Of an image without a size, an audio part without a length, a document without a page count.
UNKNOWN_TOKENS = {"image": 256, "audio": 250, "document": 1024}

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(c: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    """A text without control strings, from which ``unescape`` gives the text back."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for found, code in escapes.items():
        c = F.replace(c, F.lit(found), F.lit(code))
    return c


def unescape(c: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    """The text that ``escape`` was given: doubled backslashes split it into stretches whose codes stand alone."""
    def codes(stretch):
        for found, code in escapes.items():
            stretch = F.replace(stretch, F.lit(code), F.lit(found))
        return stretch

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), codes), "\\")


def _visit(part: Column, text: Column, by_kind: dict[str, Column], other: Column) -> Column:
    """One case for each kind of part; a part of an unknown or null kind is taken as ``other``."""
    case = F.when(part["kind"] == "text", text)
    for kind, value in by_kind.items():
        case = case.when(part["kind"] == kind, value)
    return case.otherwise(other)


def _flat(part: Column) -> Column:
    return _visit(part, escape(F.coalesce(part["text"], F.lit(""))), {k: F.lit(p) for k, p in PLACEHOLDERS.items()}, F.lit(""))


def _tokens(part: Column) -> Column:
    """The tokens that a part's placeholder stands for; 0 for text."""
    patches = F.ceil(part["width"] / PATCH_PIXELS) * F.ceil(part["height"] / PATCH_PIXELS)
    sizes = {"image": patches, "audio": F.ceil(part["seconds"] * AUDIO_FRAMES), "document": part["pages"].cast("long") * PAGE_TOKENS}
    return _visit(part, F.lit(0).cast("long"), {k: F.coalesce(s.cast("long"), F.lit(UNKNOWN_TOKENS[k]).cast("long")) for k, s in sizes.items()}, F.lit(0).cast("long"))


def text_parts(text: Column) -> Column:
    """A text as an array of one text part; null becomes an empty text."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    return F.array(part).cast(f"array<{PART}>")


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``turns`` has conv_id, turn, role and parts (an array of PART); other
    columns are ignored. Turns go by number, a null number first; ties go by
    role and content, and repeated rows stay. A null role or text is empty, a
    null array of parts has none, and a part of an unknown kind gives nothing.
    Rows with a null conv_id are one conversation. loss_spans are code points,
    ends exclusive. A conversation is one row of output, and so one row's
    limits are its own; turns are formatted before they are brought together.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.expr(f"cast(array() as array<{PART}>)"))
    single = turns.select(F.col("conv_id"), F.col("turn"), role.alias("role"), parts.alias("parts"))
    others = F.filter("parts", lambda p: p["kind"].isin(*PLACEHOLDERS))
    single = single.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(TURN), escape(F.col("role"), ROLE_ESCAPES), F.lit(ROLE_END)).alias("head"),
        F.array_join(F.transform("parts", _flat), "").alias("content"),
        F.transform(others, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attached"),
        F.col("role").isin(*loss_roles).alias("in_loss"),
    )
    chats = single.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "head", "attached", "in_loss"))).alias("turns"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def mask(a, t):
        start = a["at"] + F.length(t["head"])
        end = start + F.length(t["content"])
        spans = F.when(t["in_loss"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["spans"])
        return F.struct((end + len(END) + 1).alias("at"), spans.alias("spans"))

    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END + "\n"))), "").alias("formatted"),
        F.aggregate("turns", zero, mask, lambda a: a["spans"]).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted chat: an array of (role, texts, kinds).

    ``texts`` are the stretches of text around the placeholders, one more than
    ``kinds``, the placeholders' kinds in order.
    """
    ended = F.split(formatted, END + "\n", -1)
    marks = "|".join(PLACEHOLDERS.values())

    def read(turn):
        at = F.instr(turn, ROLE_END)
        content = F.substring(turn, at + len(ROLE_END), F.length(turn))
        return F.struct(
            unescape(F.substring(turn, F.lit(len(TURN) + 1), at - len(TURN) - 1), ROLE_ESCAPES).alias("role"),
            F.transform(F.split(content, marks, -1), lambda x: unescape(x)).alias("texts"),
            F.transform(F.regexp_extract_all(content, F.lit(marks), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.length(m) - 2)).alias("kinds"),
        )

    return F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), read)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, stretch by stretch."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
