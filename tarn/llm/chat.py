"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Template: each turn is ``### <role>: <text></turn>\\n``. Inside roles and texts a backslash becomes two,
``</turn>`` becomes ``\\e``, ``###`` becomes ``\\h`` and, in roles, ``:`` becomes ``\\c``; so control
strings of a text never look like the template's own, and the escapes undo exactly.

Every assistant turn is an example of its own. Its context is all that precedes it, which is a prefix
of the conversation's one formatted string; an example therefore is that string's key and three offsets
(context end, loss start, loss end) and needs no copy of the prefix. ``example_texts`` writes the texts
out. One shuffle by conversation; offsets come from a running sum in it.

Defined results: null texts and roles are empty; turns sort by turn, then role, then text, so ties and
repeated rows keep one order and all count; a conversation without assistant turns has no examples and
empty loss text; turns with a null conv_id are one conversation, of a null id; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
TARGET = "assistant"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    c = _swap(_swap(_swap(c, "\\", "\\\\"), "</turn>", "\\e"), "###", "\\h")
    return _swap(c, ":", "\\c") if role else c


def unescape(c: Column) -> Column:
    """Undo ``escape``: between doubled backslashes, the single ones are escapes."""
    parts = F.split(c, "\\\\\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: _swap(_swap(_swap(x, "\\e", "</turn>"), "\\h", "###"), "\\c", ":")), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, spans (array of context_end, loss_start, loss_end in code points)."""
    src = turns.select(turns["conv_id"], turns["turn"], F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(SEP))
    w = Window.partitionBy("conv_id").orderBy(*order)
    laid = (
        src.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
        .withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
        .withColumn("n", F.row_number().over(w))
        .withColumn("end", F.sum(F.length("piece").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.length("piece"))
    )
    a = F.col("start") + F.length("head")
    span = F.when(F.col("role") == TARGET, F.struct(F.col("n"), F.col("start").alias("context_end"), a.alias("loss_start"), (a + F.length("body")).alias("loss_end")))
    return laid.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )


def expand_examples(formatted: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """One row an assistant turn: conv_id, example, context_end, loss_start, loss_end, and columns to keep.

    ``outer`` gives conversations without assistant turns a row without an example.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    return formatted.select("conv_id", *keep, explode("spans").alias("example", "s")).select("conv_id", *keep, "example", "s.context_end", "s.loss_start", "s.loss_end")


def example_texts(formatted: DataFrame) -> DataFrame:
    """Each example written out: context, target (escaped) and the end marker; its size is the prefix's."""
    cut = lambda a, b: F.substring(F.col("formatted"), (a + 1).cast("int"), (b - a).cast("int"))
    rows = formatted.select("conv_id", "formatted", F.posexplode("spans").alias("example", "s"))
    return rows.select("conv_id", "example", cut(F.lit(0), F.col("s.loss_start")).alias("context"), F.concat(cut(F.col("s.loss_start"), F.col("s.loss_end")), F.lit(CLOSE)).alias("target"))


def parse_formatted(c: Column) -> Column:
    """Array of struct(role, text) read back from a formatted string."""
    pieces = F.split(c, CLOSE, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        rest = F.substring(p, len(OPEN) + 1, 1 << 30)
        at = F.instr(rest, SEP)
        return F.struct(unescape(rest.substr(F.lit(1), at - 1)).alias("role"), unescape(rest.substr(at + len(SEP), F.length(rest))).alias("text"))

    return F.transform(pieces, turn)


def chat_digests(turns: DataFrame) -> DataFrame:
    """Format, expand, and read turns and loss text back from the output."""
    f = F.col("formatted")
    read = format_conversations(turns).withColumn("turns", parse_formatted(f))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    of_turns = {"n_turns": F.size("turns").cast("long"), "turns_sha256": F.sha2(F.encode(lines, "UTF-8"), 256), "formatted_chars": F.length(f).cast("long")}
    whole = read.select("conv_id", f, "spans", *[c.alias(n) for n, c in of_turns.items()])
    target = unescape(f.substr((F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    examples = expand_examples(whole, "formatted", *of_turns, outer=True).select("conv_id", *of_turns, "example", target.alias("target"))
    met = examples.groupBy("conv_id").agg(*[F.first(n).alias(n) for n in of_turns], F.count("example").alias("n_examples"), F.array_sort(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "target")))).alias("targets"))
    loss = F.array_join(F.transform("targets", lambda x: x["target"]), "")
    return met.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '###', '\h'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h') || '</turn>' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
