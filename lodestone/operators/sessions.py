"""Conversations: history, anchors of earlier turns, follow-up questions and their rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as p
from ..functions import text as t
from ..functions import vocab as v

KEPT = 20


def history(df: DataFrame, n: int = KEPT, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(turn))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def context(df: DataFrame, n: int = 5, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """The last n messages as lines `Role: content`; n bounds what is gathered for a session."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct(turn, line.alias("line"))))
    return history(df, n, session, turn).groupBy(session).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("context"))


def anchors(c: str | Column) -> Column:
    """Topics named in a message, the most specific kind first: array of struct(rank, kind, anchor)."""
    c = t.col(c)
    stop = F.array(*(F.lit(w) for w in v.NO_NOUN))
    kind = "array<struct<rank:int,kind:string,anchor:string>>"
    found = []
    for rank, name, pattern in v.ANCHORS:
        xs = F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)), lambda x: (x != "") & ~F.array_contains(stop, x))
        named = [F.lit(rank).alias("rank"), F.lit(name).alias("kind")]
        found.append(F.transform(xs, lambda x: F.struct(*named, x.alias("anchor"))).cast(kind))  # noqa: B023

    def once(y: Column) -> Column:
        return F.filter(y["x"], lambda e, i: F.array_position(y["low"], F.lower(e["anchor"])) == i + 1)

    return t.let(t.let(F.concat(*found), lambda x: F.struct(x.alias("x"), F.transform(x, lambda e: F.lower(e["anchor"])).alias("low"))), once)


def best_anchor(df: DataFrame, session: str = "session_id", turn: str = "turn", content: str = "content", n: int = KEPT) -> DataFrame:
    """For each message the best anchor of the n messages before it: the most specific kind, then the latest
    message, then the first in it. A window's minimum over a bounded frame."""
    first = F.get(anchors(content), F.lit(0))
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(-n, -1)
    rows = df.withColumn("__a", first).withColumn("__a", F.when(F.col("__a").isNotNull(), F.struct(F.col("__a.rank"), (-F.col(turn)).alias("back"), F.col("__a.anchor"))))
    return rows.withColumn("anchor", F.min("__a").over(w)["anchor"]).drop("__a")


def rewrite(df: DataFrame, query: str = "content", anchor: str = "anchor") -> DataFrame:
    """Adds is_followup, rewritten and reason."""
    q, a = F.col(query), F.col(anchor)
    trimmed = F.regexp_replace(q, rf"^{v.WS}+|{v.WS}+$", "")
    empty = q.isNull() | (trimmed == "")
    swapped = F.concat(a, F.regexp_replace(trimmed, v.LEADING, ""))
    leading = trimmed.rlike(v.LEADING)
    out = df.withColumn("is_followup", F.coalesce(p.is_followup(query), F.lit(False)))
    reason = (
        F.when(empty, "empty_query").when(~F.col("is_followup"), "not_followup").when(a.isNull(), "no_anchor_found")
        .when(F.contains(F.lower(q), F.lower(a)), "anchor_already_present").when(leading, "pronoun_substitution").otherwise("anchor_appended")
    )
    out = out.withColumn("reason", reason)
    changed = F.when(F.col("reason") == "pronoun_substitution", swapped).when(F.col("reason") == "anchor_appended", F.concat(trimmed, F.lit(" (regarding "), a, F.lit(")")))
    return out.withColumn("rewritten", F.coalesce(changed, q))


def summary(df: DataFrame, session: str = "session_id", at: str = "at") -> DataFrame:
    """A8."""
    return df.groupBy(session).agg(F.count("*").alias("message_count"), F.min(at).alias("created"), F.max(at).alias("updated")).orderBy(F.desc("updated"), session)


def clear(df: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """ST9: all but some sessions."""
    return df.join(sessions.select(session), session, "left_anti")


def append(df: DataFrame, new: DataFrame, n: int = KEPT, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """ST5: messages added, and each session cut to its last n."""
    return history(df.unionByName(new), n, session, turn)
