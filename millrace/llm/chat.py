"""Chat formatting checked by a grammar round trip.

A turn is rendered by a template, read back by a parser for the template's grammar, and what was read
is compared with the source. Where the two differ, the text is escaped and rendered anew; escaping is
marked in the turn's head, can be undone, and leaves no ``<`` from which a piece of the template
could be made, so the second reading is identical. Turns that read back alone read back in a row,
since each ends with the mark that the parser cuts at; the whole conversation is read once more and
the result reports whether it came out ``identical``.

Grammar, with ROLE and escaped TEXT free of ``<``:

    conversation = turn*
    turn         = "<turn " FLAG " " ROLE ">\\n" TEXT "</turn>"
    FLAG         = "raw" | "esc"

Turns are worked on as rows; only the finished strings of a conversation meet. Everything is a column
expression; no user function runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import text_or_empty

OPEN, CLOSE = "<turn ", "</turn>"

SPANS = "array<struct<start:bigint,length:bigint,escape:boolean>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role_escaped(role: Column) -> Column:
    """Roles are always escaped, and free of what ends a head."""
    return F.replace(F.replace(escaped(role), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("&nl;"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("&nl;"), F.lit("\n")), F.lit("&gt;"), F.lit(">")))


def _head(role: Column, escape: Column) -> Column:
    flag = F.when(escape, F.lit("esc ")).otherwise(F.lit("raw "))
    return F.concat(F.lit(OPEN), flag, _role_escaped(role), F.lit(">\n"))


def _body(text: Column, escape: Column) -> Column:
    return F.when(escape, escaped(text)).otherwise(text)


def render(role: Column, text: Column, escape: Column) -> Column:
    return F.concat(_head(role, escape), _body(text, escape), F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns that the grammar finds, as an array of (role, text).

    What does not begin with a head reads as a turn without role, so it cannot pass for a source turn.
    """
    parts = F.split(formatted, CLOSE)
    whole = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        end = F.locate(">\n", part)
        proper = part.startswith(OPEN) & (end > 0)
        escape = F.substr(part, F.lit(len(OPEN) + 1), F.lit(4)) == "esc "
        role = F.substr(part, F.lit(len(OPEN) + 5), end - (len(OPEN) + 5))
        body = F.substr(part, end + 2)
        return F.struct(
            F.when(proper, _role_unescaped(role)).alias("role"),
            F.when(escape, unescaped(body)).otherwise(body).alias("text"),
        )

    return F.transform(whole, turn)


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``turns`` as read back (role, text), ``loss_spans``
    (start from 1 and length in code points of ``formatted``, escaped or not), ``turn_spans`` (the same
    by turn, null for turns without loss), ``escaped_turns``, ``identical``.

    Turns are put in order of turn, role and text; repeated rows are turns of their own. Null texts and
    roles count as empty, null turns come first, a null conversation id is an id. Other columns are
    not used. An empty table gives an empty result. A conversation is one output row, so its rendered
    turns meet in one place: that is the unit of the format.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        text_or_empty(F.col(role_col)).alias("role"),
        text_or_empty(F.col(text_col)).alias("text"),
    )
    source, no = F.struct("role", "text"), F.lit(False)
    alone = parse(render(F.col("role"), F.col("text"), no))
    rendered = turns.withColumn("escape", ~F.array(source).eqNullSafe(alone)).withColumns(
        {
            "head": F.length(_head(F.col("role"), F.col("escape"))),
            "body": F.length(_body(F.col("text"), F.col("escape"))),
            "string": render(F.col("role"), F.col("text"), F.col("escape")),
        }
    )
    in_order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.sum(F.length("string")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rendered.withColumn("place", F.row_number().over(in_order)).withColumn(
        "start", F.coalesce(before, F.lit(0)) + F.col("head") + 1
    )
    span = F.struct("start", F.col("body").cast("long").alias("length"), "escape")
    lossy = F.col("role") == loss_role
    whole = (
        placed.withColumn("source", source)
        .withColumn("span", F.when(lossy, span))
        .groupBy("conv")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "string", "source", "span"))).alias("all"),
            F.count_if("escape").alias("escaped_turns"),
        )
        .withColumn("formatted", F.array_join(F.transform("all", lambda t: t["string"]), ""))
        .withColumn("turns", parse(F.col("formatted")))
    )
    return whole.select(
        F.col("conv").alias(conv_col),
        "formatted",
        "turns",
        F.array_compact(F.transform("all", lambda t: t["span"])).cast(SPANS).alias("loss_spans"),
        F.transform("all", lambda t: t["span"]).cast(SPANS).alias("turn_spans"),
        "escaped_turns",
        F.transform("all", lambda t: t["source"]).eqNullSafe(F.col("turns")).alias("identical"),
    )


def loss_text(formatted: Column, turn_spans: Column) -> Column:
    """All text under the loss mask, unescaped, read from the formatted string.

    The string is cut once at the ends of its turns, and a span is read from the end of its turn, so
    the work grows with the string's length, not with turns times length.
    """

    def part(turn: Column, span: Column) -> Column:
        body = F.substr(turn, (F.length(turn) - span["length"] + 1).cast("int"), span["length"].cast("int"))
        return F.when(span["escape"], unescaped(body)).otherwise(F.when(span.isNotNull(), body))

    return F.array_join(F.zip_with(F.split(formatted, CLOSE), turn_spans, part), "")
