"""Chat formatting from typed content parts.

A message is a list of parts: text, image, audio or document. A visitor with one rule per type flattens them in
order: text is escaped, the others become placeholders, with a record of the attachment and of the number of
tokens the placeholder stands for. Turns are framed by control strings; control strings inside texts and roles,
also those that begin in one text part and end in another, are escaped so that they can be read back.

Only DataFrame functions are used. Null text is empty, a null role is the empty role, null parts are skipped; rows
with a null conversation id form one conversation; rows of equal turn are ordered by role and text, repeated rows
stay. An empty table gives an empty table. Further columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import bind, cut, run_sums

#: The frame of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Stands before placeholders until texts are escaped, and before a mark of its own where texts hold it.
MARK = "\u0001"
#: Turns of a conversation that are joined at first; blocks are joined after that.
BLOCK = 64
#: Tokens of placeholders: pixels to a side of an image patch, tokens per second of audio and per page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    lines = F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1"))
    return escape(lines)


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"))).cast(
        "array<struct<type:string,text:string>>")


def full_parts(text: Column) -> Column:
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *[F.lit(None).cast(t).alias(n) for n, t in none.items()]))


def _image(p: Column) -> Column:
    side = lambda c: F.ceil(F.greatest(F.coalesce(p[c], F.lit(0)), F.lit(1)) / PATCH)
    return side("width") * side("height")


#: Type of a part -> tokens its placeholder stands for.
TOKENS = {
    "image": _image,
    "audio": lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE),
    "document": lambda p: F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS,
}


def visit(parts: Column) -> Column:
    """Flattened parts as array<struct<text, ref, tokens>>; unknown types are taken as text, ref is null there. Texts are
    marked, not escaped yet: see ``body_of``."""
    def rule(p: Column) -> Column:
        plain = F.struct(F.replace(F.coalesce(p["text"], F.lit("")), F.lit(MARK), F.lit(MARK + "0")).alias("text"),
                         F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))
        out = plain
        for kind, tokens in TOKENS.items():
            held = F.struct(F.lit(f"{MARK}1{kind}").alias("text"), F.coalesce(p["ref"], F.lit("")).alias("ref"),
                            tokens(p).cast("long").alias("tokens"))
            out = F.when(p["type"] == kind, held).otherwise(out)
        return out

    return F.transform(F.filter(parts, lambda p: p.isNotNull()), rule)


def body_of(flat: Column) -> Column:
    """The visited parts as one text: texts are joined before they are escaped, placeholders are not escaped."""
    text = escape(F.array_join(F.transform(flat, lambda x: x["text"]), ""))
    for kind in TOKENS:
        text = F.replace(text, F.lit(f"{MARK}1{kind}"), F.lit(f"<|{kind}|>"))
    return F.replace(text, F.lit(MARK + "0"), F.lit(MARK))


def format_chat(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, ``loss`` (array<struct<start, stop>> in code points of
    ``formatted``, the bodies of turns of role ``learn``), ``attachments`` (references in order) and
    ``attachment_tokens``.
    """
    name = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    flat = visit(F.coalesce(F.col(f"`{parts}`"), F.array().cast(f"array<{PART}>")))
    turns = rows.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        name.alias("role"), F.concat(F.lit(OPEN), escape_role(name), F.lit("\n")).alias("head"),
        flat.alias("flat"))
    piece = turns.select("conv_id", "turn", F.struct(
        F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("head").alias("head"),
        body_of(F.col("flat")).alias("body"),
        F.transform(F.filter("flat", lambda x: x["ref"].isNotNull()), lambda x: x["ref"]).alias("refs"),
        F.aggregate("flat", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens")).alias("p"))

    def joined(p: Column) -> Column:
        """Ordered turns as one text, with the lengths of heads, bodies and ends and what is learnt."""
        return F.struct(
            F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE + "\n"))), "")
            .alias("text"),
            F.transform(p, lambda x: F.struct(
                F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"),
                (x["role"] == learn).alias("learn"))).alias("lens"),
            F.flatten(F.transform(p, lambda x: x["refs"])).alias("refs"),
            F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"))

    blocks = (piece.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"))
              .agg(F.array_sort(F.collect_list("p")).alias("p"))
              .select("conv_id", "block", bind(F.col("p"), joined).alias("j")))
    whole = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(-(1 << 62))).alias("block"), "j"))).alias("b"))
    lens = F.flatten(F.transform("b", lambda x: x["j"]["lens"]))

    def spans(ls: Column) -> Column:
        ends = run_sums(F.transform(ls, lambda x: x["head"] + x["body"] + len(CLOSE) + 1))
        placed = F.zip_with(ls, ends, lambda x, e: F.struct(
            (e - len(CLOSE) - 1 - x["body"]).alias("start"), (e - len(CLOSE) - 1).alias("stop"),
            x["learn"].alias("learn")))
        return F.transform(F.filter(placed, lambda x: x["learn"]), lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop")))

    return whole.select(
        "conv_id", F.array_join(F.transform("b", lambda x: x["j"]["text"]), "").alias("formatted"),
        bind(lens, spans).alias("loss"),
        F.flatten(F.transform("b", lambda x: x["j"]["refs"])).alias("attachments"),
        F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["j"]["tokens"]).alias("attachment_tokens"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    framed = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda t: t.startswith(OPEN))

    def turn(t: Column) -> Column:
        inner = F.substring(t, len(OPEN) + 1, F.length(t))
        return bind(F.struct(inner.alias("t"), F.locate("\n", inner).alias("n")), lambda x: F.struct(
            unescape_role(F.substring(x["t"], F.lit(1), x["n"] - 1)).alias("role"),
            unescape(F.substring(x["t"], x["n"] + 1, F.length(x["t"]))).alias("text")))

    return F.transform(framed, turn)


def chat_digest(chats: DataFrame) -> DataFrame:
    """Digests of what can be read back from formatted conversations."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (chats.select(
        "conv_id", read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(cut(F.col("formatted"), F.col("loss")), unescape), "").alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"), "attachment_tokens")
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                "formatted_chars"))
