"""Chat formatting: ordered turns of a conversation as one training text, with DataFrame functions only.

The project keeps no conversations. Its nearest records are the cleaned exams, which the
signature names: an enrollment (``id_inscripcion``) is a conversation, an attempt
(``numero_intento``) a turn, its result (``resultado``) the role and its grade (``nota``)
the text; the loss is then on the grades of passed attempts.

The turns of a conversation are collected and sorted; turns of one role that follow each
other become one block; blocks are joined to a text. Marks tell where a block starts, where
its role ends, where a turn follows another one inside it and where it ends. A mark that
occurs inside a role or a text gets a backslash after its first character, and a backslash
another one, so no text can be taken for a mark and everything can be read back.

Turns are ordered by turn (null first), then role, then text, so repeated and tied rows have
a fixed order and each is a turn. Null roles and texts are empty. A null conversation id is a
conversation as well. A conversation is one row of the result and thus at most 2 GB.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
# Running sums are formed in slices of about so many numbers, since an array that grows is copied.
SLICE = 256


@dataclass(frozen=True)
class Template:
    """The marks of a text; ``loss_role`` is the role whose texts are learned."""

    start: str = "[INST]"
    role_end: str = "[/INST]"
    following: str = "[NEXT]"
    end: str = "</s>"
    loss_role: str = "assistant"

    @property
    def marks(self) -> list[str]:
        return [getattr(self, f.name) for f in fields(self) if f.name != "loss_role"]

    def __post_init__(self) -> None:
        for mark in self.marks:
            if len(mark) < 2 or ESCAPE in mark:
                raise ValueError(f"a mark has at least two characters and no backslash: {mark!r}")
            for other in self.marks:
                tails = [mark[i:] for i in range(1, len(mark))]
                if any(other.startswith(tail) for tail in tails) or (mark != other and mark in other):
                    raise ValueError(f"the marks {mark!r} and {other!r} can overlap")
        if len(set(self.marks)) < len(self.marks):
            raise ValueError("two marks are equal")


CHAT = Template()
ATTEMPTS = Template(loss_role="Aprobado")


def escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in template.marks:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(ESCAPE)), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def running(numbers: Column) -> Column:
    """The sum of all numbers before each one."""

    def sums(start: Column, values: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda all_, v: F.concat(all_, F.array(F.element_at(all_, -1) + v)))

    zero = F.lit(0).cast("bigint")
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / SLICE).cast("int")), lambda i: F.slice(numbers, i * SLICE + 1, SLICE)
    )
    whole = F.transform(parts, lambda p: F.aggregate(p, zero, lambda total, v: total + v))
    each = F.zip_with(parts, F.slice(sums(zero, whole), 1, F.size(parts)), lambda p, s: F.slice(sums(s, p), 1, F.size(p)))
    return F.when(F.size(numbers) > 0, F.flatten(each)).otherwise(F.array().cast("array<bigint>"))


def format_turns(
    rows: DataFrame,
    conversation: str = "id_inscripcion",
    turn: str = "numero_intento",
    role: str = "resultado",
    text: str = "nota",
    template: Template = ATTEMPTS,
) -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``n_blocks``, ``formatted`` and ``loss_spans``.

    A span is ``start`` (the code points before it) and ``length`` in ``formatted``; there is one
    for each text of the loss role, in order. Spans of one block lie on both sides of a mark.
    Other columns of ``rows`` are not read.
    """
    given = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    turns = rows.select(F.col(conversation).alias("c"), given.alias("t")).groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """What a turn adds to the text: the mark before it, itself, the mark after it."""
        size = F.size("turns")
        first = (i == 0) | (F.get("turns", i - 1).getField("role") != t.role)
        last = (i == size - 1) | (F.get("turns", i + 1).getField("role") != t.role)
        head = F.concat(F.lit(template.start), escaped(t.role, template), F.lit(template.role_end))
        return F.struct(
            F.when(first, head).otherwise(F.lit(template.following)).alias("before"),
            escaped(t.text, template).alias("body"),
            F.when(last, F.lit(template.end)).otherwise(F.lit("")).alias("after"),
            first.alias("first"),
            (t.role == F.lit(template.loss_role)).alias("loss"),
        )

    def length(p: Column) -> Column:
        return (F.length(p.before) + F.length(p.body) + F.length(p.after)).cast("bigint")

    pieces = turns.select("c", F.transform("turns", piece).alias("pieces"))
    sized = pieces.select("c", "pieces", F.transform("pieces", length).alias("sizes"))
    placed = sized.select("c", "pieces", running(F.col("sizes")).alias("starts"))
    spans = F.zip_with(
        "pieces",
        "starts",
        lambda p, s: F.struct(p.loss.alias("loss"), (s + F.length(p.before)).alias("start"), F.length(p.body).cast("bigint").alias("length")),
    )
    return placed.select(
        F.col("c").alias(conversation),
        F.size("pieces").cast("bigint").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p.first)).cast("bigint").alias("n_blocks"),
        F.concat_ws("", F.transform("pieces", lambda p: F.concat(p.before, p.body, p.after))).alias("formatted"),
        F.transform(F.filter(spans, lambda s: s.loss), lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))).alias("loss_spans"),
    )


def _parts(text: Column, mark: str) -> Column:
    """A text cut at every mark."""
    return F.split(text, r"\Q" + mark + r"\E", -1)


def read_turns(
    formatted: DataFrame, conversation: str = "id_inscripcion", template: Template = ATTEMPTS, also: Sequence[str] = ()
) -> DataFrame:
    """The conversations read back from their formatted texts and spans alone.

    One row each: its id, ``turns`` (an array of ``role`` and ``text``) and ``learned``, the
    texts under the loss mask. Columns named in ``also`` are carried along.
    """

    def parsed(block: Column) -> Column:
        role = F.substring(F.element_at(_parts(block, template.role_end), 1), len(template.start) + 1, 1 << 30)
        texts = _parts(F.element_at(_parts(block, template.role_end), 2), template.following)
        return F.struct(unescaped(role).alias("role"), texts.alias("texts"))

    def turns(block: Column) -> Column:
        return F.transform(block.texts, lambda t: F.struct(block.role.alias("role"), unescaped(t).alias("text")))

    blocks = F.transform(F.filter(_parts(F.col("formatted"), template.end), lambda b: b != ""), parsed)
    return formatted.select(
        conversation,
        *also,
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.transform("loss_spans", lambda s: unescaped(F.col("formatted").substr((s.start + 1).cast("int"), s.length.cast("int")))).alias("learned"),
    )


def digest(formatted: DataFrame, conversation: str = "id_inscripcion", template: Template = ATTEMPTS) -> DataFrame:
    """Checksums of what ``read_turns`` finds in formatted texts, and the code points of these.

    ``turns_sha256`` is over role and text of every turn, each with a line feed behind it;
    ``loss_sha256`` over the texts under the loss mask with nothing between them.
    """
    read = read_turns(formatted, conversation, template, also=["formatted"])
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    joined = read.select(
        conversation, F.size("turns").cast("bigint").alias("n_turns"), F.concat_ws("", lines).alias("lines"),
        F.concat_ws("", "learned").alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return joined.select(
        conversation,
        "n_turns",
        F.sha2("lines", 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
