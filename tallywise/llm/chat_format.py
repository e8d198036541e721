"""Chat formatting over typed content parts, in built-in Spark functions.

A turn holds an ordered array of parts. Each part has a ``kind`` (text, image,
audio or document), a ``text`` and, for attachments, a ``ref`` and a number of
``units`` (tiles of an image, seconds of audio, pages of a document). The visitor
walks over the parts in order and flattens them: a text part gives its escaped
text, an attachment a placeholder ``<|kind:number|>``, whose number counts the
attachments of the conversation. Next to the text it records the attachment
references (number, kind, ref, expanded tokens) and the loss spans, which cover the
text parts of assistant turns.

Template: ``<|turn|>`` role, line feed, content, ``<|end|>`` per turn. Control
strings inside a role or text are escaped reversibly: a backslash is doubled, and
one is put behind the first character of each control string, which takes the
template's own and those of common chat templates apart.

Turns are ordered by ``turn`` (nulls first), ties by role and content, so repeated
rows keep their number. Null text, role, ref or units: empty, empty, empty, 0. A
null conversation id is a conversation of its own. An unknown kind is an
attachment that expands to its units. Empty input gives an empty result. A
conversation is one string, which is what is asked for; its turns are escaped
before they are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>"
#: First and further characters of control strings of chat templates.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|/?SYS>>|</?SYS>>)"
#: Tokens that one unit of an attachment expands to.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PART = "struct<kind:string,text:string,ref:string,units:long>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one plain text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"),
    ))


def visit(turns: DataFrame) -> DataFrame:
    """Turns with ``parts`` flattened to pieces: what is written, and kind, ref and units of an attachment."""

    def flatten(part: Column) -> Column:
        is_text = F.coalesce(part["kind"] == "text", F.lit(True))
        return F.struct(
            F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).alias("written"),
            F.when(~is_text, part["kind"]).alias("kind"),
            F.coalesce(part["ref"], F.lit("")).alias("ref"),
            F.coalesce(part["units"], F.lit(0).cast("long")).alias("units"),
        )

    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.transform(parts, flatten).alias("pieces"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, attachments, expanded_tokens``.

    ``turns`` has ``conv_id, turn, role, parts``. ``loss_spans`` are (start, length)
    in code points of ``formatted``, start from 1. Numbers of attachments and
    starts of turns are running sums over the turns of a conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "pieces")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per_unit = (
        "CASE p.kind " + " ".join(f"WHEN '{k}' THEN {n}L" for k, n in TOKENS_PER_UNIT.items())
        + " ELSE 1L END"
    )
    df = visit(turns).withColumn("n_attached", F.expr("size(filter(pieces, p -> p.kind IS NOT NULL))"))
    df = df.withColumn("seen", F.coalesce(F.sum("n_attached").over(before), F.lit(0)))
    df = df.withColumn("pieces", F.expr(f"""
        transform(pieces, (p, i) -> struct(
            coalesce(p.written, concat('<|', p.kind, ':', seen + size(filter(slice(pieces, 1, i), q -> q.kind IS NOT NULL)), '|>')) AS written,
            p.kind IS NULL AS is_text,
            IF(p.kind IS NULL, NULL, struct(
                seen + size(filter(slice(pieces, 1, i), q -> q.kind IS NOT NULL)) AS number,
                p.kind AS kind, p.ref AS ref, {per_unit} * p.units AS tokens)) AS attachment))
    """))
    opening = F.concat(F.lit(TURN), F.regexp_replace(escape(F.col("role")), "\n", "\\\\\n"), F.lit("\n"))
    df = df.select(
        "conv_id", "turn", "role", "pieces", opening.alias("opening"),
        F.concat(opening, F.expr("array_join(transform(pieces, p -> p.written), '')"), F.lit(END)).alias("written"),
    )
    df = df.withColumn("start", F.coalesce(F.sum(F.length("written")).over(before), F.lit(0)) + 1)
    spans = F.expr("""
        IF(role <> 'assistant', CAST(array() AS ARRAY<STRUCT<start: BIGINT, n: BIGINT>>), aggregate(pieces,
          struct(start + length(opening) AS at, CAST(array() AS ARRAY<STRUCT<start: BIGINT, n: BIGINT>>) AS spans),
          (acc, p) -> struct(acc.at + length(p.written) AS at,
            IF(p.is_text, concat(acc.spans, array(struct(acc.at AS start, CAST(length(p.written) AS LONG) AS n))), acc.spans) AS spans),
          acc -> acc.spans))
    """)
    attached = F.expr("filter(transform(pieces, p -> p.attachment), a -> a IS NOT NULL)")
    return (
        df.select("conv_id", "start", "written", spans.alias("spans"), attached.alias("attached"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "written", "spans", "attached"))).alias("turns"))
        .select(
            "conv_id",
            F.expr("array_join(transform(turns, t -> t.written), '')").alias("formatted"),
            F.expr("flatten(transform(turns, t -> t.spans))").alias("loss_spans"),
            F.expr("flatten(transform(turns, t -> t.attached))").alias("attachments"),
            F.expr("aggregate(turns, 0L, (n, t) -> n + aggregate(t.attached, 0L, (m, a) -> m + a.tokens))").alias("expanded_tokens"),
        )
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and loss text recovered from ``formatted`` and ``loss_spans`` alone.

    ``turns`` are (role, text) in order, texts unescaped; ``loss_text`` is the
    unescaped text under the spans, joined without separators.
    """

    def turn(written: Column) -> Column:
        # The role ends at the first line feed that is not escaped.
        head = F.regexp_extract(written, r"^((?:\\[\s\S]|[^\\\n])*)\n", 1)
        return F.struct(
            unescape(head).alias("role"),
            unescape(F.substring(written, F.length(head) + 2, F.length(written))).alias("text"),
        )

    # A turn's marks cannot occur inside a role or text, since those are escaped.
    written = F.array_remove(F.split("formatted", r"\Q" + END + r"\E"), "")
    return chats.select(
        *chats.columns,
        F.transform(written, lambda x: turn(F.substring(x, F.lit(len(TURN) + 1), F.length(x)))).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(
            F.substring(F.col("formatted"), s["start"].cast("int"), s["n"].cast("int")))), "").alias("loss_text"),
    )
