"""Chat formatting with typed content parts, by DataFrame functions alone.

A turn's content is an array of typed parts. A visitor over the parts flattens text, image, audio and document parts into
one string with ordered placeholders; each placeholder that stands for an attachment is recorded with its reference and
the number of tokens it expands to. A template wraps the turns of a conversation in control strings. Control strings that
occur inside texts or roles are broken by an escape character after their first character, and the escape character is
doubled, so that the formatted string can be read back without loss.

Conversations are ordered by turn (null first), ties by role and then by the parts as they came, before anything is escaped; null texts, roles and
parts are empty. Repeated rows are turns of their own. Offsets are running sums over the ordered turns, so long conversations cost no more a turn
than short ones. A conversation is one output row, so its length bounds the row that holds it. Columns besides the four named ones don't come along; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: type: text, image, audio or document. units: image width and height, audio seconds or document pages (null: 0).
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Template:
    """Control strings of a turn: start role sep text end. ``patch``: pixels a side per image token."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    escape: str = "\\"
    patch: int = 28
    tokens_per_second: float = 25.0
    tokens_per_page: int = 256
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.sep, self.end, self.image, self.audio, self.document)

    def java(self, s: str) -> str:
        return re.sub(r"([\\^$.|?*+()\[\]{}<>=!:/&-])", r"\\\1", s)

    def escaped(self, text: Column) -> Column:
        """An escape character goes before each escape character and after the first character of each control string."""
        inside = "|".join(f"(?<={self.java(c[0])})(?={self.java(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.coalesce(text, F.lit("")), f"(?={self.java(self.escape)})|{inside}", self.java(self.escape))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"(?s){self.java(self.escape)}(.)", "$1")


DEFAULT = Template()


def expanded_tokens(part: Column, t: Template) -> Column:
    """Tokens that an attachment stands for; 0 for text."""
    zero = F.lit(0)
    patches = lambda x: F.ceil(F.coalesce(x, zero) / t.patch)
    return (
        F.when(part["type"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * t.tokens_per_second))
        .when(part["type"] == "document", F.coalesce(part["pages"], zero) * t.tokens_per_page)
        .otherwise(zero)
        .cast("long")
    )


def visit(part: Column, t: Template) -> Column:
    """One part as formatted text. Unknown types and null parts give nothing."""
    return F.when(
        part["type"] == "text", t.escaped(part["text"])
    ).when(part["type"] == "image", F.lit(t.image)).when(part["type"] == "audio", F.lit(t.audio)).when(
        part["type"] == "document", F.lit(t.document)
    ).otherwise(F.lit(""))


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a turn."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("ref"), none("int").alias("width"),
            none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")
        )
    )


def format_chat(turns: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: ``id_col``, ``formatted``, ``loss_spans`` and ``attachments``.

    loss_spans: array of (turn_no, start, length), in code points of ``formatted``, one for each turn to learn. attachments: array of
    (turn_no, part_no, kind, ref, n_tokens) in the order of their placeholders.
    """
    t = template
    given = F.filter(F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), given.alias("parts"))
    role, parts = F.col("role"), F.col("parts")
    head = F.concat(F.lit(t.start), t.escaped(role), F.lit(t.sep))
    body = F.array_join(F.transform(parts, lambda p: visit(p, t)), "")
    attachment = lambda p, i: F.struct(i.alias("part_no"), p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p, t).alias("n_tokens"))
    attached = F.filter(F.transform(parts, attachment), lambda a: a["kind"].isin("image", "audio", "document"))
    order = Window.partitionBy("id").orderBy("turn", "role", "parts")
    length = (F.char_length(head) + F.char_length(body) + len(t.end)).cast("long")
    begun = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("*", F.row_number().over(order).alias("no"), begun.alias("begun"))
    placed = placed.select("id", F.struct("no", "begun", head.alias("head"), body.alias("body"), attached.alias("attached"), role.isin(*t.loss_roles).alias("learn")).alias("t"))
    grouped = placed.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    turn_text = lambda x: F.concat(x["head"], x["body"], F.lit(t.end))
    span = lambda x: F.struct(
        (x["no"] - 1).alias("turn_no"), (x["begun"] + F.char_length(x["head"])).alias("start"),
        F.char_length(x["body"]).cast("long").alias("length")
    )
    spans = F.transform(F.filter("ts", lambda x: x["learn"]), span)
    listed = lambda x, i: F.transform(
        x["attached"],
        lambda a: F.struct(
            i.alias("turn_no"), a["part_no"].alias("part_no"), a["kind"].alias("kind"), a["ref"].alias("ref"),
            a["n_tokens"].alias("n_tokens")
        )
    )
    return grouped.select(
        F.col("id").alias(id_col), F.array_join(F.transform("ts", turn_text), "").alias("formatted"), spans.alias("loss_spans"),
        F.flatten(F.transform("ts", listed)).alias("attachments")
    )


def _turn_strings(formatted: Column, t: Template) -> Column:
    """The turns as they were written, without their end."""
    return F.filter(F.split(formatted, t.java(t.end), -1), lambda x: x != "")


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped; placeholders stay as they are."""
    t = template
    inner = lambda x: F.substring(x, len(t.start) + 1, 2**31 - 1)
    role = lambda x: F.substring_index(inner(x), t.sep, 1)
    return F.transform(
        _turn_strings(formatted, t),
        lambda x: F.struct(
            t.unescaped(role(x)).alias("role"),
            t.unescaped(F.substring(inner(x), F.char_length(role(x)) + len(t.sep) + 1, F.lit(2**31 - 1))).alias("text")
        )
    )


def read_loss(formatted: Column, spans: Column, template: Template = DEFAULT) -> Column:
    """The texts under the loss mask, in order, unescaped.

    Each span is sorted in front of its turn, whose last characters it names: no turn is looked for from the beginning of the conversation.
    """
    t = template
    none = lambda kind: F.lit(None).cast(kind)
    turns = F.transform(_turn_strings(formatted, t), lambda x, i: F.struct(i.cast("int").alias("no"), F.lit(1).alias("kind"), none("int").alias("length"), x.alias("x")))
    asked = F.transform(spans, lambda s: F.struct(s["turn_no"].cast("int").alias("no"), F.lit(0).alias("kind"), s["length"].cast("int").alias("length"), none("string").alias("x")))
    both = F.array_sort(F.concat(turns, asked))
    pairs = F.zip_with(both, F.slice(both, F.lit(2), F.size(both)), lambda a, b: F.struct(a["length"].alias("length"), b["x"].alias("x")))
    return F.transform(F.filter(pairs, lambda p: p["length"].isNotNull()), lambda p: t.unescaped(F.substring(p["x"], -p["length"], p["length"])))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = format_chat(turns.unionByName(extra).withColumn("parts", text_parts(F.col("text"))))
    loss = F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "")
    back = out.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        digest(
            F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
        ).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars"
    )


_COUNTED = " + ".join(f"(length({{c}}) - length(replace({{c}}, '{c}', ''))) // {len(c)}" for c in (*DEFAULT.controls, DEFAULT.escape))
_FRAME = len(DEFAULT.start) + len(DEFAULT.sep) + len(DEFAULT.end)
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({_FRAME} + length(role) + length(text) + {_COUNTED.format(c='text')} + {_COUNTED.format(c='role')})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
