"""Human review as append-only events: ids, latest states, history, tails and counts. Every event has a seq in its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine import constants as C


def sequential_ids(events: DataFrame) -> DataFrame:
    """Place of each event in its session's log, from 1: a running count, per session."""
    return events.withColumn("id", F.row_number().over(Window.partitionBy("session").orderBy("ts", "seq")).cast("long"))


def history(events: DataFrame) -> DataFrame:
    """Each event with the state before it."""
    return events.withColumn("previous", F.lag("state").over(Window.partitionBy("session", "entity").orderBy("seq")))


def latest(events: DataFrame) -> DataFrame:
    """Last state of each entity, without those that are cleared."""
    return events.groupBy("session", "entity").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq")).filter("state <> 'cleared'")


def override_counts(states: DataFrame) -> DataFrame:
    """Entities by override status, one column for each allowed one."""
    return states.groupBy("session").agg(*(F.count_if(F.col("state") == s).cast("long").alias(s) for s in C.OVERRIDES), F.count("*").alias("total"))


def audit_counts(events: DataFrame) -> DataFrame:
    """Events by action and by actor over the whole log."""
    grouped = events.groupingSets([["action"], ["actor"]], "action", "actor")
    return grouped.agg(F.grouping("action").cast("long").alias("by_actor"), F.count("*").alias("n")).select(
        F.when(F.col("by_actor") == 1, "actor").otherwise("action").alias("kind"), F.coalesce("action", "actor").alias("key"), "n"
    )


def tail(events: DataFrame, n: int = 100) -> DataFrame:
    """The last n events by seq; 0 means all."""
    return events if n == 0 else events.orderBy(F.desc("seq")).limit(n)


def priority_rank(priority: Column) -> Column:
    out = None
    for i, p in enumerate(C.PRIORITIES):
        out = F.when(priority == p, i) if out is None else out.when(priority == p, i)
    return out.otherwise(len(C.PRIORITIES)).cast("int")


def revision_summary(revisions: DataFrame) -> DataFrame:
    """Counts over all revisions; priorities count the pending ones alone."""
    pending = F.col("status") == "pending"
    return revisions.groupBy("session").agg(
        F.count("*").alias("total"), F.count_if(pending).cast("long").alias("pending"), F.count_if(~pending).cast("long").alias("resolved"),
        *(F.count_if(pending & (F.col("priority") == p)).cast("long").alias(p) for p in C.PRIORITIES),
    )


def with_side_effects(events: DataFrame) -> DataFrame:
    """Review events with the override events that they bring: a requested revision sets needs_revision, a resolved one
    pending; a cleared override is a tombstone."""
    kind = F.col("action")
    state = F.when(kind == "override_set", F.col("value")).when(kind == "override_cleared", "cleared").when(kind == "revision_requested", "needs_revision").when(kind == "revision_resolved", "pending")
    return events.select("session", "entity", "seq", state.alias("state")).filter("state IS NOT NULL")


def determination(events: DataFrame) -> DataFrame:
    """Last determination of each session: notes are required, and conditions if it is conditional."""
    good = F.col("state").isin(*C.DETERMINATIONS) & (F.coalesce("notes", F.lit("")) != "") & ((F.col("state") != "conditional") | (F.coalesce("conditions", F.lit("")) != ""))
    cleared = F.col("state") == "cleared"
    last = events.filter(good | cleared).groupBy("session").agg(F.max_by(F.struct("state", "seq"), "seq").alias("d"))
    return last.select("session", F.when(F.col("d.state") != "cleared", F.col("d.state")).alias("determination"), F.col("d.seq").alias("seq"))


def derived_status(completed: dict[str, Column]) -> Column:
    """Status of the most advanced stage that is completed."""
    return F.coalesce(*(F.when(completed[k], F.lit(label)) for k, label in C.STAGES if k in completed), F.lit("Initialized"))
