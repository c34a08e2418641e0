"""Latest-state queries over append-only logs, scheduling and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.operators.graph import cut


def latest(log: DataFrame, keys: list[str], at: str, now, tie: str) -> DataFrame:
    """Newest row of each key at ``now``: a struct maximum, combined on the map side."""
    rest = [c for c in log.columns if c not in keys]
    best = log.where(F.col(at) <= F.lit(now)).groupBy(*keys).agg(F.max(F.struct(F.col(at), F.col(tie), *[c for c in rest if c not in (at, tie)])).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def retained(points: DataFrame, group: str, order: str, metric: str, keep: int) -> DataFrame:
    """(group, id, why): the newest ``keep`` rows, and the one of the best metric."""
    newest = Window.partitionBy(group).orderBy(F.col(order).desc(), F.col("id").desc())
    best = Window.partitionBy(group).orderBy(F.col(metric).desc(), "id")
    r = points.withColumn("n", F.row_number().over(newest)).withColumn("b", F.row_number().over(best))
    return r.where((F.col("n") <= keep) | (F.col("b") == 1)).select(group, "id", F.when(F.col("n") <= keep, "recent").otherwise("best").alias("why"))


def live_memory(log: DataFrame, now: int, needle: str, most: int) -> DataFrame:
    """Entries that are not replaced, retracted, early or expired and hold ``needle``; by confidence, recency and id."""
    gone = log.where("replaces_id is not null").select(F.col("replaces_id").alias("memory_id"))
    live = log.where((F.col("action") != "retract") & (F.col("created_at") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & F.contains(F.lower("content"), F.lit(needle)))
    return live.join(gone, "memory_id", "left_anti").orderBy(F.desc("confidence_ppm"), F.desc("created_at"), "memory_id").limit(most)


def stale_facts(facts: DataFrame, now: int) -> DataFrame:
    """fact_id, stale: not the latest of (subject, attribute), expired, from the future, or dependent on a stale fact.

    Staleness spreads over dependency edges until nothing changes, however deep they go; the loop carries ids only.
    """
    newest = Window.partitionBy("subject_id", "attribute").orderBy(F.col("recorded_at").desc(), F.col("fact_id").desc())
    base = facts.withColumn("k", F.row_number().over(newest)).select("fact_id", ((F.col("k") > 1) | (F.col("expires_at") <= now) | (F.col("recorded_at") > now)).alias("s"), "depends_on")
    edges = cut(base.select("fact_id", F.explode("depends_on").alias("on")))
    state = cut(base.select("fact_id", "s"))
    n, now_n = -1, state.where("s").count()
    while now_n != n:
        n = now_n
        bad = edges.join(state.where("s").select(F.col("fact_id").alias("on")), "on", "left_semi").select("fact_id").distinct().withColumn("h", F.lit(True))
        state = cut(state.join(bad, "fact_id", "left").select("fact_id", (F.col("s") | F.coalesce("h", F.lit(False))).alias("s")))
        now_n = state.where("s").count()
    return state.withColumnRenamed("s", "stale")
