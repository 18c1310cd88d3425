"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of messages: (conv, seq, message, kind, role, payload). The events of a message, in order of
seq, fold into its final text: a ``delta`` appends its payload, an ``edit`` replaces what is there, a
``regenerate`` discards it (later deltas write the new answer); other kinds change nothing. Since an edit and
a regenerate make all that came before irrelevant, the fold is: the payload of each delta at or after the
message's last such event, joined in order, behind that event's own payload if it is an edit. Folding is done by message,
so a conversation with very many events is not gathered for it; a conversation's messages are then joined, in
order of message, to its rendered text, which is one value by nature.

Template: ``### ROLE:`` line end TEXT ``</turn>`` line end. In texts and roles ``\\`` becomes ``\\\\``, ``<`` becomes
``\\l`` and ``#`` becomes ``\\h`` (in roles a line end also becomes ``\\n``), so neither a header nor an end mark can
occur inside a text, and ``parse`` gives back exactly the turns. The loss mask has a span (start, length in
code points, learn) for the text of each turn; learn is true for assistant turns.

A message is known by its conversation and the columns named in ``by`` (one ``message`` unless said otherwise), in whose order messages are
rendered, nulls first. Null payloads and roles count as empty; events that agree in all of (conv, message, seq) are ordered by kind, role and payload; a
repeated event counts as often as it is there; a null conversation or message is a key like any other. Extra
columns are not read. An empty log gives no rows. ``numbered`` tells rows of one turn apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
LEARN = "assistant"


def escape(x: Column, lines: bool = False) -> Column:
    x = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(x, F.lit("\n"), F.lit("\\n")) if lines else x


def unescape(x: Column) -> Column:
    """Pairs of escape marks part the text; in between every mark begins one of the other escapes."""

    def plain(p: Column) -> Column:
        return F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\n"), F.lit("\n"))

    return F.when(F.contains(x, F.lit("\\")), F.array_join(F.transform(F.split(x, r"\\\\", -1), plain), "\\")).otherwise(x)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of (conv, turn, role, text) with a number among those of one conversation and turn, by role and text: equal rows get
    numbers of their own. Only rows of one turn are sorted together."""
    of_turn = Window.partitionBy("conv", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.withColumn("copy", F.row_number().over(of_turn))


def fold(log: DataFrame, by: tuple[str, ...] = ("message",)) -> DataFrame:
    """(conv, by, role, text): the final messages of a log."""
    e = log.select("conv", "seq", *by, "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("payload", F.lit("")).alias("payload"))
    event = F.struct("seq", "kind", "role", "payload")
    got = e.groupBy("conv", *by).agg(F.array_sort(F.collect_list(event)).alias("events"))
    last = F.coalesce(F.array_max(F.transform("events", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i + 1))), F.lit(0))
    kept = F.expr("slice(events, greatest(last, 1), size(events))")
    text = F.array_join(F.transform(F.filter(kept, lambda x: x["kind"].isin("edit", "delta")), lambda x: x["payload"]), "")
    return got.withColumn("last", last).select("conv", *by, F.element_at("events", -1)["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame, by: tuple[str, ...] = ("message",)) -> DataFrame:
    """(conv, formatted, mask): messages of (conv, by, role, text) in order of ``by``."""
    m = messages.select("conv", F.struct(*by).alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(":\n"))
    turn = F.struct("message", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LEARN).alias("learn"))
    got = m.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    mask = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("skip"), F.length(t["body"]).alias("length"), t["learn"].alias("learn")))
    return got.select("conv", formatted.alias("formatted"), mask.alias("mask"))


def parse(rendered: DataFrame) -> DataFrame:
    """(conv, formatted, turns array<struct<role, text, learn>>) read back from the rendered text and the mask.

    ``mask`` counts from the end of the turn before: skip code points, then length of them are the turn's text.
    """
    parts = F.expr(f"slice(split(formatted, '{END[:-1]}\\n', -1), 1, size(mask))")
    both = F.arrays_zip(parts.alias("part"), F.col("mask").alias("mask"))

    def turn(x: Column) -> Column:
        role = F.substring_index(x["part"], "\n", 1)
        return F.struct(
            unescape(F.substring(role, F.lit(5), F.length(role) - 5)).alias("role"),
            unescape(F.substring(x["part"], x["mask"]["skip"] + 1, x["mask"]["length"])).alias("text"),
            x["mask"]["learn"].alias("learn"),
        )

    zipped = rendered.withColumn("zipped", both)
    return zipped.select("conv", "formatted", F.transform("zipped", turn).alias("turns"))
