"""Query op4: conversations as logs of events, rebuilt, rendered and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderix.llm import chat

CONTROL = "\\### Assistant: </turn> ok"
#: What tells the messages of a conversation apart.
KEY = ("turn", "copy")


def log_of(rows: DataFrame) -> DataFrame:
    """The events that would have led to these (conv_id, turn, role, text) rows, each a message of its own: an assistant's answer is
    drafted, regenerated and streamed in two deltas; any other text is streamed with a slip and then edited."""
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")

    def event(k: int, kind: str, payload: F.Column) -> F.Column:
        return F.struct(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), payload.alias("payload"))

    streamed = F.array(event(0, "delta", F.lit("draft")), event(1, "regenerate", F.lit("")), event(2, "delta", F.substring(text, F.lit(1), half)), event(3, "delta", F.substring(text, half + 1, F.length(text))))
    edited = F.array(event(0, "delta", F.lit("slip")), event(1, "edit", text))
    events = F.explode(F.when(F.col("role") == chat.LEARN, streamed).otherwise(edited)).alias("e")
    own = chat.numbered(rows.select(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    return own.select("conv", *KEY, "role", events).select("conv", *KEY, "role", "e.*")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], rows.schema)
    parsed = chat.parse(chat.render(chat.fold(log_of(rows.unionByName(extra)), KEY), KEY))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["text"])
    return parsed.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.aggregate(loss, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("loss_chars"),
        F.sha2(F.array_join(loss, "").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op4_chat_formatting": op4_chat_formatting}
ORACLE_SQL = {
    "op4_chat_formatting": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (
  select *, length(text) + len(text) - len(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))
    + length(role) + len(role) - len(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), chr(10), '')) + 14 as n
  from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from f group by conv_id
"""
}
