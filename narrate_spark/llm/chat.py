"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document).  A visitor
flattens them in order: text is escaped, the others become placeholders, and the
attachments are kept with their place and the number of tokens they expand to.
All of it is column expressions; a turn is one row, so a conversation of any
length is formatted row by row.

A turn is rendered as ``<|turn|>ROLE\\nBODY<|end|>\\n``.  In texts, the first
character of each control string is written as a backslash code, and so is each
backslash, which makes texts unambiguous and the rendering reversible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common

TURN, END = "<|turn|>", "<|end|>"
# Strings that templates in use read as control; each is escaped in texts.
ANGLED = r"<(?=/?s>|/?SYS>|\|)"
SQUARE = r"\[(?=/?INST\])"
LOSS_ROLE = "assistant"
# Tokens that one unit of an attachment expands to: an image patch, a second of
# audio, a page of a document.
UNIT_TOKENS = {"image": 1, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"

DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def escape(text: Column) -> Column:
    r"""Text without control strings; backslash is ``\b``, a first ``<`` ``\l``, a first ``[`` ``\q``."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(F.regexp_replace(plain, ANGLED, r"\\l"), SQUARE, r"\\q")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    for code, char in (("\\l", "<"), ("\\q", "["), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


class PartVisitor:
    """Turns one content part into text; override a method to change its form."""

    unit_tokens = UNIT_TOKENS

    def text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def image(self, part: Column) -> Column:
        return F.lit("<|image|>")

    def audio(self, part: Column) -> Column:
        return F.lit("<|audio|>")

    def document(self, part: Column) -> Column:
        return F.lit("<|document|>")

    def other(self, part: Column) -> Column:
        return F.lit("<|attachment|>")

    def visit(self, part: Column) -> Column:
        """The part's text by its type; a part without type is text."""
        kind = F.coalesce(part["type"], F.lit("text"))
        return (
            F.when(kind == "text", self.text(part))
            .when(kind == "image", self.image(part))
            .when(kind == "audio", self.audio(part))
            .when(kind == "document", self.document(part))
            .otherwise(self.other(part))
        )

    def tokens(self, part: Column) -> Column:
        """Tokens that the part's placeholder expands to; 0 for text, 1 at least for others."""
        count = F.lit(1).cast("bigint")
        for kind, per_unit in self.unit_tokens.items():
            count = F.when(part["type"] == kind, F.greatest(count, F.coalesce(part["units"], F.lit(1)) * per_unit)).otherwise(count)
        return F.when(F.coalesce(part["type"], F.lit("text")) == "text", 0).otherwise(count)


def text_part(text: Column) -> Column:
    """Content of a turn that is a single text; a null text is empty."""
    return F.array(
        F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("units"))
    ).cast(PARTS)


def format_turns(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """Render each turn: (conv_id, turn, role, content) to text, loss span and attachments.

    ``content`` is an array of parts (``PARTS``).  A null role is an empty one, null
    content is an empty text; null ids are kept.  ``loss_start`` and ``loss_chars``
    span the body of an assistant's turn, and are null and 0 for others.
    ``attachments`` lists reference, type, place in the body's order and tokens.
    """
    visitor = visitor or PartVisitor()
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = F.filter(F.coalesce(F.col("content"), F.array().cast(PARTS)), lambda p: p.isNotNull())
    head = F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = F.array_join(F.transform(parts, visitor.visit), "")
    attached = F.transform(
        F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text"),
        lambda p, i: F.struct(
            p["ref"].alias("ref"), p["type"].alias("type"), i.alias("place"), visitor.tokens(p).cast("bigint").alias("tokens")
        ),
    )
    learned = role == LOSS_ROLE
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), head.alias("head"), body.alias("body"), learned.alias("learned"), attached.alias("attachments")
    ).select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(f"{END}\n")).alias("formatted"),
        F.when(F.col("learned"), F.char_length("head")).alias("loss_start"),
        F.when(F.col("learned"), F.char_length("body")).otherwise(0).cast("long").alias("loss_chars"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """Role and text of formatted turns, and the text under the loss mask, read from the rendering alone."""
    rest = F.substr("formatted", F.lit(len(TURN) + 1))
    role = F.substring_index(rest, "\n", 1)
    inner = F.substr("formatted", F.lit(len(TURN) + 2) + F.char_length(role))
    body = F.substr(inner, F.lit(1), F.char_length(inner) - len(END) - 1)
    loss = F.when(
        F.col("loss_start").isNotNull(), F.substr("formatted", F.col("loss_start") + 1, F.col("loss_chars").cast("int"))
    )
    return formatted.select(
        "conv_id",
        "turn",
        unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"),
        unescape(body).alias("text"),
        unescape(loss).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Digests of each conversation's turns in order.

    A digest over a sequence is taken in order, so a conversation is streamed
    through one task row by row; nothing of it is held but the state of two digests.
    Turns of one number are taken in order of role and text.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in DIGEST}
        key: object = digest  # no conversation yet
        n = chars = loss_chars = 0
        every = learned = hashlib.sha256()

        def close() -> None:
            values = (key, n, every.hexdigest(), loss_chars, learned.hexdigest(), chars)
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)

        for b in batches:
            for conv, role, text, loss, size in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")), strict=True):
                if conv != key:
                    if key is not digest:
                        close()
                    key, n, chars, loss_chars = conv, 0, 0, 0
                    every, learned = hashlib.sha256(), hashlib.sha256()
                n, chars = n + 1, chars + size
                every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss is not None:
                    loss_chars += len(loss)
                    learned.update(loss.encode("utf-8", "surrogatepass"))
            if len(out["conv_id"]) >= 4096:
                yield common.batch(out, DIGEST)
                out = {f.name: [] for f in DIGEST}
        if key is not digest:
            close()
            yield common.batch(out, DIGEST)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss", "chars").mapInArrow(
        digest,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one that speaks in control strings, formatted, written and read back."""
    said = F.lit("</s>[INST] ok [/INST]")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    turns = common.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    content = turns.unionByName(hard).withColumn("content", text_part(F.col("text")))
    return digest_conversations(read_turns(common.stored(format_turns(content))))


_ESCAPED = (
    "regexp_replace(regexp_replace(replace({0}, '\\', '\\b'), '<(/?s>|/?SYS>|\\|)', '\\\\l\\1', 'g'),"
    " '\\[(/?INST\\])', '\\\\q\\1', 'g')"
)
ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(replace({_ESCAPED.format("role")}, chr(10), '\\n')) + length({_ESCAPED.format("text")})) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""
