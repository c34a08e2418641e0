"""Queries over logs, metrics, streams and the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield.operators import logs, metrics
from loomfield.plans.registry import query
from loomfield.sources.tables import table
from loomfield.streaming import events as stream

NOW = "2024-01-20 00:00:00"


@query("latest_state", f"SELECT user_id, event_type, event_id, value FROM events WHERE ts <= TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    """JON-16/17: latest fact of each subject and attribute."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return logs.latest(e, ["user_id", "event_type"], "ts", F.to_timestamp(F.lit(NOW)), "event_id").select("user_id", "event_type", "event_id", "value")


@query("as_of_join", "SELECT a.event_id, max({'ts': b.ts, 'id': b.event_id}).id AS last_click FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.ts <= a.ts WHERE a.event_type = 'error' GROUP BY a.event_id")
def _(spark, d):
    """JON-16: each error's latest earlier click, by one window over the union instead of a range join."""
    e = table(spark, d, "events").where("event_type in ('error', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_click", F.max(F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))).over(w)["event_id"]).where("event_type = 'error' and last_click is not null").select("event_id", "last_click")


@query("stale_facts")
def _(spark, d):
    """JON-16/18: staleness over dependencies (tested against recursion)."""
    e = table(spark, d, "events")
    f = e.select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("attribute"), F.unix_timestamp("ts").alias("recorded_at"), (F.unix_timestamp("ts") + 864000).alias("expires_at"), F.when(F.col("event_id") >= 500, F.array(F.col("event_id") - 500)).otherwise(F.array().cast("array<bigint>")).alias("depends_on"))
    return logs.stale_facts(f, 1705708800)


@query("retention_plan", """
WITH r AS (SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b FROM events)
SELECT user_id, id, CASE WHEN n <= 3 THEN 'recent' ELSE 'best' END AS why FROM r WHERE n <= 3 OR b = 1""")
def _(spark, d):
    """TOP-04/05."""
    return logs.retained(table(spark, d, "events").withColumnRenamed("event_id", "id"), "user_id", "ts", "value", 3)


@query("memory_retrieve", """
WITH m AS (SELECT event_id AS memory_id, event_type AS content, (value * 1000)::BIGINT AS confidence_ppm, epoch(ts)::BIGINT AS created_at, CASE WHEN event_id % 9 = 0 THEN event_id - 3 END AS replaces_id FROM events)
SELECT memory_id, confidence_ppm FROM m WHERE created_at <= 1705708800 AND contains(content, 'err') AND memory_id NOT IN (SELECT replaces_id FROM m WHERE replaces_id IS NOT NULL) ORDER BY confidence_ppm DESC, created_at DESC, memory_id LIMIT 20""")
def _(spark, d):
    """TOP-02, STR-01: live entries of an append-only log."""
    e = table(spark, d, "events")
    m = e.select(F.col("event_id").alias("memory_id"), F.col("event_type").alias("content"), F.round(F.col("value") * 1000).cast("bigint").alias("confidence_ppm"), F.unix_timestamp("ts").alias("created_at"), F.lit(None).cast("bigint").alias("expires_at"), F.lit("assert").alias("action"), F.when(F.col("event_id") % 9 == 0, F.col("event_id") - 3).alias("replaces_id"))
    return logs.live_memory(m, 1705708800, "err", 20).select("memory_id", "confidence_ppm")


@query("scheduler_pick", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def _(spark, d):
    """TOP-06: first ready entry by priority, deadline and id."""
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@query("context_budget", """
WITH c AS (SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations), r AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used FROM c)
SELECT conv_id, turn, used FROM r WHERE used <= 2000""")
def _(spark, d):
    """TOP-03: newest turns that fit a budget."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("used")).where("used <= 2000")


@query("replay_candidates", "SELECT user_id, event_id, value * 1.1 AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def _(spark, d):
    """TOP-11: the first pick of each context has the novelty bonus, so greedy order equals a rank."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_id", (F.col("value") * 1.1).alias("score"))


@query("value_per_cost_plan", "SELECT p_partkey, sum(p_size) OVER (ORDER BY p_retailprice / p_size DESC, p_partkey)::BIGINT AS cost FROM part QUALIFY cost <= 500 ORDER BY 1")
def _(spark, d):
    """TOP-12: best value a cost while the budget lasts; only rows of the top prefix are ranked."""
    top = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / F.col("p_size")).alias("v")).orderBy(F.desc("v"), "p_partkey").limit(500)  # every size is 1 at least
    return top.withColumn("cost", F.sum("p_size").over(Window.orderBy(F.desc("v"), "p_partkey"))).where("cost <= 500").select("p_partkey", "cost")


@query("consensus_decision", "SELECT conv_id, CASE WHEN count(DISTINCT text) = 1 THEN 'accept' WHEN count(DISTINCT text) = 0 THEN 'reject' ELSE 'disagreement' END AS decision FROM (SELECT conv_id, CASE WHEN role = 'assistant' THEN text END AS text FROM conversations) GROUP BY conv_id")
def _(spark, d):
    """TOP-13."""
    n = F.countDistinct(F.when(F.col("role") == "assistant", F.col("text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.when(n == 1, "accept").when(n == 0, "reject").otherwise("disagreement").alias("decision"))


@query("exact_match_wilson", """
WITH s AS (SELECT quality, count(*) AS n, count(*) FILTER (toxic = 0) AS h FROM labels GROUP BY quality)
SELECT quality, n, h AS hits, round((h / n + 1.959963984540054 ** 2 / (2 * n) - 1.959963984540054 * sqrt(h / n * (1 - h / n) / n + 1.959963984540054 ** 2 / (4.0 * n * n))) / (1 + 1.959963984540054 ** 2 / n), 6) AS low,
  round((h / n + 1.959963984540054 ** 2 / (2 * n) + 1.959963984540054 * sqrt(h / n * (1 - h / n) / n + 1.959963984540054 ** 2 / (4.0 * n * n))) / (1 + 1.959963984540054 ** 2 / n), 6) AS high FROM s""")
def _(spark, d):
    """AGG-07."""
    s = table(spark, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 0).alias("hits"))
    low, high = metrics.wilson(F.col("hits"), F.col("n"))
    return s.select("quality", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("evaluation_delta", "SELECT a.lang AS a, b.lang AS b, round(b.m - a.m, 6) AS delta FROM (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY lang) a JOIN (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY lang) b ON a.lang < b.lang")
def _(spark, d):
    """AGG-08: directional delta of comparable reports."""
    m = table(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("m"))
    a, b = m.select(F.col("lang").alias("a"), F.col("m").alias("ma")), m.select(F.col("lang").alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.col("mb") - F.col("ma"), 6).alias("delta"))


@query("chrf_by_role")
def _(spark, d):
    """AGG-09/10: chrF of each reply against the turn before it (tested against Python)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("ref", F.lag("text").over(w)).where("role = 'assistant' and ref is not null")
    return metrics.chrf(c.select("role", F.concat_ws(":", "conv_id", "turn").alias("seg"), F.col("text").alias("pred"), "ref"), ["role"])


@query("retrieval_prf", """
WITH c AS (SELECT lang AS category, [source, lang] AS expected, CASE WHEN n_chars % 3 = 0 THEN [source] WHEN n_chars % 3 = 1 THEN [source, 'x'] ELSE [lang, source] END AS predicted FROM documents),
s AS (SELECT category, len(list_intersect(expected, predicted)) / len(predicted) AS p, len(list_intersect(expected, predicted)) / len(expected) AS r, (len(list_intersect(expected, predicted)) = len(expected) AND len(predicted) = len(expected))::INT::DOUBLE AS e FROM c)
SELECT coalesce(category, 'ALL') AS category, count(*) AS cases, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(e), 6) AS exact FROM s GROUP BY ROLLUP (category)""")
def _(spark, d):
    """AGG-11/12."""
    m = F.col("n_chars") % 3
    c = table(spark, d, "documents").select(F.col("lang").alias("category"), F.array("source", "lang").alias("expected"), F.when(m == 0, F.array("source")).when(m == 1, F.array("source", F.lit("x"))).otherwise(F.array("lang", "source")).alias("predicted"))
    return metrics.set_scores(c)


@query("capability_gap", "SELECT quality, round(greatest(0, 0.9 - (avg(1 - toxic) + 0.25 * least(1, sqrt(ln(40) / (2 * count(*)))))), 6) AS gap FROM labels GROUP BY quality")
def _(spark, d):
    """AGG-13."""
    s = F.avg(1 - F.col("toxic")) + 0.25 * F.least(F.lit(1.0), F.sqrt(F.log(F.lit(40.0)) / (2 * F.count(F.lit(1)))))
    return table(spark, d, "labels").groupBy("quality").agg(F.round(F.greatest(F.lit(0.0), 0.9 - s), 6).alias("gap"))


@query("serving_telemetry", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY 1")
def _(spark, d):
    """AGG-14."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value")).select(F.col("w.start").alias("day"), "requests", "errors", "mean_value", "max_value")


@query("tokenizer_candidates", "SELECT lang AS stratum, CASE WHEN sum(octet_length(encode(text))) <= sum(2 * length(text)) THEN 'byte' ELSE 'pair' END AS chosen, sum(octet_length(encode(text)))::BIGINT AS byte_units, sum(2 * length(text))::BIGINT AS pair_units FROM documents GROUP BY lang")
def _(spark, d):
    """AGG-15: the candidate with fewer units."""
    b, p = F.sum(F.octet_length("text")), F.sum(2 * F.length("text"))
    return table(spark, d, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.when(b <= p, "byte").otherwise("pair").alias("chosen"), b.alias("byte_units"), p.alias("pair_units"))


@query("event_dedup_stream", "SELECT event_id, user_id FROM events")
def _(spark, d):
    """STR-03/04/05: each event once, by a stream with a watermark."""
    return stream.to_table(stream.once_each(stream.read_events(spark, d)).select("event_id", "user_id"))


@query("hourly_stream", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    """STR-02: windowed state, complete mode."""
    return stream.to_table(stream.hourly(stream.read_events(spark, d)), "complete").withColumn("value", F.round("value", 4))


@query("latest_state_stream", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    """STR-01/06/07: keyed latest state."""
    return stream.to_table(stream.latest_by_user(stream.read_events(spark, d)), "complete")


@query("session_activity", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, s""")
def _(spark, d):
    """Sessions with a gap of 30 minutes."""
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


@query("lineage_chain", "WITH RECURSIVE c AS (SELECT event_id AS root, event_id AS id, 0 AS depth FROM events UNION ALL SELECT root, id // 2, depth + 1 FROM c WHERE id > 1) SELECT root, count(*) AS length FROM c GROUP BY root")
def _(spark, d):
    """JON-18, STR-08: length of the chain of causal parents id // 2 down to 1, which is the number of binary digits: Spark's recursion stops at a million rows."""
    length = F.when(F.col("event_id") > 1, F.length(F.bin("event_id"))).otherwise(1).cast("bigint")
    return table(spark, d, "events").groupBy(F.col("event_id").alias("root")).agg(F.sum(length).alias("length"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _(spark, d):
    """Grouped aggregate with a filter that reaches the scan."""
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("region_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY n_name")
def _(spark, d):
    """Star join; small sides are broadcast by the planner's own size estimate."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").where("r_regionkey = 2"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("order_semi_anti", "SELECT o_orderpriority, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS returned, count(*) AS orders FROM orders GROUP BY 1")
def _(spark, d):
    """Semi-join as a flag."""
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    return table(spark, d, "orders").join(r, F.col("o_orderkey") == F.col("k"), "left").groupBy("o_orderpriority").agg(F.count("k").alias("returned"), F.count(F.lit(1)).alias("orders"))
