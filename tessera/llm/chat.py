"""Chat formatting with typed content parts, as DataFrame expressions alone.

A conversation's turns are marked `<|im_start|>role`, newline, content, `<|im_end|>`,
newline.  A visitor turns each content part into text of the content: image, audio and
document parts become ordered placeholders, and the text between two of them, of however
many parts, is escaped as one, so that it can hold no control string, nor form one across
parts.  Attachments are recorded with their position and the tokens that the
placeholder expands to.  The loss mask holds the assistants' contents.

Escaping is reversible: backslashes are doubled, then a backslash goes after the first
character of every control string.  No control string survives it, and unescaping drops
a backslash and keeps the character that follows.

Turns are placed by a running sum over the conversation's ordered rows, so that time and
memory grow as its text, however many turns it has.

Cases: null text, role or part is empty; turns are ordered by turn (null first), then
role, then content; repeated rows are turns of their own; a null conv_id is a
conversation; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What texts may not hold unescaped: all of this template's strings begin with the first; the others belong to common templates.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
#: While parts are joined: what stands for an attachment, and for its first character in texts.
_MARK, _AS_MARK, _CUT = "\x01", "\x01a", "\x01b"
#: The type of a content part.
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    # a backslash may be followed by a newline too (in roles); the kept character is the second of a pair, if it is a backslash
    return F.regexp_replace(text, r"\\(\\?)", "$1")


@dataclass(frozen=True)
class PartVisitor:
    """Placeholders and expanded token counts of content parts; override to fit a model."""

    patch: int = 14
    tokens_per_second: float = 25.0
    tokens_per_page: int = 560
    chars_per_token: int = 4

    def text(self, part: Column) -> tuple[Column, Column]:
        """The text as it is (it is escaped with its neighbours), and its tokens."""
        said = F.coalesce(part.text, F.lit(""))
        return said, F.ceil(F.length(said) / F.lit(float(self.chars_per_token)))

    def image(self, part: Column) -> tuple[Column, Column]:
        side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(float(self.patch)))
        return F.lit("<|image|>"), F.greatest(F.lit(1), side(part.width) * side(part.height))

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.greatest(F.lit(1), F.ceil(F.coalesce(part.seconds, F.lit(0.0)) * self.tokens_per_second))

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), F.greatest(F.lit(1), F.coalesce(part.pages, F.lit(1)) * self.tokens_per_page)

    def visit(self, part: Column) -> Column:
        """struct(kind, uri, content, tokens): a text or a placeholder; an unknown kind is read as text."""
        kinds: dict[str, Callable] = {"image": self.image, "audio": self.audio, "document": self.document}
        content, tokens = self.text(part)
        for kind, method in kinds.items():
            c, t = method(part)
            content, tokens = F.when(part.kind == kind, c).otherwise(content), F.when(part.kind == kind, t).otherwise(tokens)
        kind = F.when(part.kind.isin(*kinds), part.kind).otherwise("text")
        return F.struct(kind.alias("kind"), part.uri.alias("uri"), F.coalesce(content, F.lit("")).alias("content"), tokens.cast("long").alias("tokens"))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return text_parts(F.array(text))


def text_parts(texts: Column) -> Column:
    """A content of text parts, from an array of texts."""
    null = F.lit(None)
    rest = [null.cast("string"), null.cast("int"), null.cast("int"), null.cast("double"), null.cast("int")]
    return F.transform(texts, lambda t: F.struct(F.lit("text"), t, *rest).cast(PART))


def format_conversations(rows: DataFrame, visitor: PartVisitor | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """rows (conv_id, turn, role, parts array<PART>), one per turn -> one row per conversation.

    conv_id, formatted, loss_mask array<struct<start, end>> (characters of formatted),
    attachments array<struct<turn, kind, uri, tokens, start>> in order, tokens (expanded).
    """
    visitor = visitor or PartVisitor()
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    turns = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        # a null part is an empty text
        F.transform(parts, lambda p: visitor.visit(F.coalesce(p, F.struct(*[F.lit(x) for x in ("text", "")], *[F.lit(None)] * 5).cast(PART)))).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda p: F.when(p.kind == "text", F.replace(p.content, F.lit(_MARK), F.lit(_AS_MARK))).otherwise(_CUT)), "")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    turns = turns.select(
        "conv_id", "turn", "role",
        # the texts before, between and after the attachments
        F.transform(F.split(joined, _CUT, -1), lambda t: escape(F.replace(t, F.lit(_AS_MARK), F.lit(_MARK)))).alias("texts"),
        F.filter("parts", lambda p: p.kind != "text").alias("held"),
        F.aggregate("parts.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
    )
    pieces = F.zip_with("texts", F.array_append("held.content", F.lit("")), lambda t, p: F.concat(t, p))
    turns = turns.withColumn("content", F.array_join(pieces, ""))
    # the character at which each turn begins; the order is total but for equal turns
    order = [F.col("turn").asc_nulls_first(), "role", "content"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = (F.length("head") + F.length("content") + F.lit(len(END))).cast("long")
    start = F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")) + F.length("head")
    placed = turns.withColumn("start", start).withColumn("end", F.col("start") + F.length("content"))
    # attachments of one turn: each begins after all texts and placeholders before it
    till = lambda k: F.aggregate(F.slice(F.col("texts"), F.lit(1), k + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(F.col("held.content"), F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x))
    attached = F.transform(
        "held",
        lambda p, k: F.struct(F.col("turn").cast("long").alias("turn"), p.kind.alias("kind"), p.uri.alias("uri"), p.tokens.alias("tokens"), (F.col("start") + till(k)).cast("long").alias("start")),
    )
    told = placed.select("conv_id", "start", "end", "role", "tokens", F.concat("head", "content", F.lit(END)).alias("said"), attached.alias("attached"))
    # turns come one behind the other: ordered by where they start
    grouped = told.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "role", "said", "attached"))).alias("t"), F.sum("tokens").alias("tokens"))
    mask = F.transform(F.filter("t", lambda t: t.role.isin(*loss_roles)), lambda t: F.struct(t.start.alias("start"), t.end.alias("end")))
    return grouped.select(
        "conv_id",
        F.array_join("t.said", "").alias("formatted"),
        mask.alias("loss_mask"),
        F.flatten("t.attached").alias("attachments"),
        "tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped; placeholders stay."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    marked = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    # the head ends at the first newline that no backslash escapes
    role = lambda p: F.regexp_extract(p, r"(?s)^<\|im_start\|>(.*?(?<!\\)(?:\\\\)*)\n", 1)
    return F.transform(
        marked,
        lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + F.lit(len(START) + 2))).alias("text")),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    Spans are cut from a form of four bytes a character, bound once, where a place is found at no cost.
    """
    cut = lambda b, s: F.decode(F.substr(b, (4 * s.start + 1).cast("int"), (4 * (s.end - s.start)).cast("int")), "UTF-32")
    return F.get(F.transform(F.array(F.encode(formatted, "UTF-32")), lambda b: F.array_join(F.transform(mask, lambda s: unescape(cut(b, s))), "")), F.lit(0))
