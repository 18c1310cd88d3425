"""Lexicon operators: a pluggable table of roots matched by prefix, exactly or inside tokens.

A prefix match (token starts with root) is an equi-join of distinct tokens: each token of all rows is cut once to its prefixes, however
many rows hold it, and what it hits is joined back on the token. Roots under three letters never hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 3
#: Roots, up to which the table is sent to every executor rather than shuffled.
SMALL = 50_000


def sized(roots: DataFrame) -> tuple[DataFrame, int]:
    """The table, broadcast if it is small, and the length of its longest root."""
    n, longest = roots.agg(F.count("*"), F.max(F.length("root"))).first()
    return (F.broadcast(roots) if n <= SMALL else roots), longest or 0


def prefix_hits(rows: DataFrame, roots: DataFrame, key: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """(key, token, root): every token of a row with every root that it starts with."""
    table, longest = sized(roots.filter(F.length("root") >= LEAST).select("root").distinct())
    each = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token")).filter(F.length("token") >= LEAST)
    words = each.select("token").distinct()
    cuts = F.explode(F.transform(F.sequence(F.lit(LEAST), F.least(F.length("token"), F.lit(max(LEAST, longest)))), lambda n: F.substring(F.col("token"), F.lit(1), n))).alias("root")
    return each.join(words.select("token", cuts).join(table, "root"), "token").select(key, "token", "root")


def exact_hits(rows: DataFrame, roots: DataFrame, key: str = "row_id", tokens: str = "tokens") -> DataFrame:
    table, _ = sized(roots.select("root").distinct())
    return rows.select(key, F.explode(F.array_distinct(tokens)).alias("root")).join(table, "root", "left_semi").select(key, F.col("root").alias("token"))


def inner_hits(rows: DataFrame, roots: DataFrame, key: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """(key, token, root) where the root is in the token behind its start: a possible collision. All pieces of each distinct token, of the lengths that roots
    have, meet the roots by equality; the lengths are rows of a join, so there may be any number."""
    table, _ = sized(roots.select("root").distinct())
    lengths = roots.select(F.length("root").alias("n")).filter(F.col("n") >= LEAST).agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    each = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    words = each.select("token").distinct().crossJoin(F.broadcast(lengths))
    cuts = words.select("token", F.explode(F.filter("lengths", lambda n: n < F.length("token"))).alias("n"))
    start = F.explode(F.sequence(F.lit(2), F.length("token") - F.col("n") + 1)).alias("i")
    pieces = cuts.select("token", "n", start).select("token", F.substring(F.col("token"), F.col("i"), F.col("n")).alias("root")).distinct()
    return each.join(pieces.join(table, "root"), "token").select(key, "token", "root")


def leaked(token: Column, short_roots: list[str]) -> Column:
    """A token that only a root too short to be used would have hit."""
    return token.isin(short_roots)


def homonym(text: Column, at: Column, cue: str, width: int = 12) -> Column:
    """A cue within so many characters of a hit's start."""
    return F.substring(text, F.greatest(at - width + 1, F.lit(1)), F.lit(2 * width)).rlike(cue)
