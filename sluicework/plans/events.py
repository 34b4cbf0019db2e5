"""Queries on the event log and the order tables: streaks, change points, retries, sessions, idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions import text as tx
from sluicework.operators import health, topk, versions
from sluicework.session import table
from sluicework.streaming import incremental


def failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    e = health.failures_in_row(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return e.select("event_id", F.col("failures").cast("bigint").alias("failures"), health.state(F.col("failures")).alias("state"), health.backoff_seconds(F.col("failures")).alias("delay"))


def user_health(spark, sf):
    """Each user's state after the last event: the log is folded, nothing is kept mutable."""
    e = health.failures_in_row(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    last = versions.latest(e.select("user_id", "ts", "event_id", "failures"), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", F.col("failures").cast("bigint").alias("failures"), health.state(F.col("failures")).alias("state"))


def change_points(spark, sf):
    out = versions.changes(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("event_id", "user_id", "old_value", F.col("event_type").alias("new_value"))


def latest_event(spark, sf):
    return versions.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


def event_props(spark, sf):
    """JSON properties, tolerant of anything that isn't an object with a number k."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def session_history(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ">").alias("history"))


def retryable(spark, sf):
    """Users with fewer than three errors on a day, and how many they have left."""
    n = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("attempts"))
    return n.where("attempts < 3").select("user_id", "day", "attempts", (F.lit(3) - F.col("attempts")).alias("left"))


def cycle_statistics(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in ("signup", "error", "click", "view", "purchase")))


def orders_insert_or_ignore(spark, sf):
    """Orders of lines that aren't yet known, one row each."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    old = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return versions.insert_or_ignore(old, li.select("l_orderkey").distinct(), ["l_orderkey"]).select("l_orderkey")


def orders_upsert(spark, sf):
    """New totals for the orders of the fifth priority; a null status keeps the old one."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where(F.col("o_orderpriority").startswith("5")).withColumn("o_orderstatus", F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.lit("X"))).withColumn("o_orderpriority", F.lit("9-NEW"))
    return versions.upsert(o, new, ["o_orderkey"], ["o_orderstatus"])


def supplier_top_per_nation(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return topk.top_k_per_group(s, "s_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey")], 3).select("s_nationkey", "rank", "s_suppkey")


def diverse_suppliers(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"), "s_acctbal")
    return topk.diverse_top_k(s, "nation", [F.col("s_acctbal").desc(), F.col("s_suppkey")], 10).select("s_suppkey", "nation")


def _stream(spark, sf, name, order):
    """The table as a stream of several files, one for each micro-batch, in the order of their arrival."""
    rows = table(spark, sf, name)
    return incremental.read_stream(spark, incremental.arrivals(rows, order), rows.schema)


def streamed_users(spark, sf):
    """The event types of each user, by stateful dedup: one row for each key, whichever comes first."""
    out = incremental.run_to_end(incremental.novel(_stream(spark, sf, "events", "ts").select("user_id", "event_type"), ["user_id", "event_type"]), "append")
    return out.select("user_id", "event_type")


def streamed_health(spark, sf):
    """Each user's state after the last micro-batch: the same as user_health."""
    rows = _stream(spark, sf, "events", "ts").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    out = incremental.run_to_end(incremental.source_health(rows, "user_id", "ts", "event_id", "failed"), "update")
    last = versions.latest(out, ["key"], ["batch"])
    return last.select(F.col("key").cast("bigint").alias("user_id"), "failures", "state")


def streamed_versions(spark, sf):
    """Contents of each monitored record over all deliveries: one event each, whatever is delivered again."""
    rows = _stream(spark, sf, "evidence_snapshot", "loaded_at").select("id", "loaded_at", "content_sha256")
    out = incremental.run_to_end(incremental.version_events(rows, "id", "loaded_at", "content_sha256"), "append")
    return out.groupBy(F.col("key").alias("id")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "new").alias("new"))


def json_answers(spark, sf):
    """Properties wrapped in talk and a code fence, as a model answers: the outermost object is found again."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nAnything else?"))
    return table(spark, sf, "events").groupBy(F.from_json(tx.json_inside(answer), "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        failure_streaks, user_health, change_points, latest_event, event_props, session_history, retryable, cycle_statistics, orders_insert_or_ignore, orders_upsert, supplier_top_per_nation, diverse_suppliers,
        streamed_users, streamed_health, streamed_versions, json_answers,
    )
}

_STREAK = """s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
    f AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS failures FROM s)"""

ORACLES = {
    "failure_streaks": f"WITH {_STREAK} SELECT event_id, failures, CASE WHEN failures >= 3 THEN 'degraded' ELSE 'enabled' END AS state, least(3600, 300 * pow(2, least(failures, 3))::INT)::INT AS delay FROM f",
    "user_health": f"WITH {_STREAK} SELECT user_id, failures, CASE WHEN failures >= 3 THEN 'degraded' ELSE 'enabled' END AS state FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "change_points": "SELECT event_id, user_id, old_value, new_value FROM (SELECT event_id, user_id, event_type AS new_value, lag(event_type) OVER w AS old_value, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k > 1 AND old_value IS DISTINCT FROM new_value",
    "latest_event": "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "event_props": "SELECT CASE WHEN json_valid(props) THEN json_extract(props, '$.k')::BIGINT END AS k, count(*) AS n FROM events GROUP BY 1",
    "session_history": "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS history FROM events GROUP BY 1",
    "retryable": "SELECT user_id, day, attempts, 3 - attempts AS left FROM (SELECT user_id, ts::DATE::VARCHAR AS day, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1, 2) WHERE attempts < 3",
    "cycle_statistics": "SELECT ts::DATE::VARCHAR AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("signup", "error", "click", "view", "purchase")) + " FROM events GROUP BY 1",
    "orders_insert_or_ignore": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "orders_upsert": "SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '5') AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN starts_with(o_orderpriority, '5') THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority FROM orders",
    "supplier_top_per_nation": "SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank, s_suppkey FROM supplier QUALIFY rank <= 3",
    "diverse_suppliers": "SELECT s_suppkey, nation FROM (SELECT s_suppkey, s_nationkey::VARCHAR AS nation, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) ORDER BY k > 1, s_acctbal DESC, s_suppkey LIMIT 10",
    "streamed_users": "SELECT DISTINCT user_id, event_type FROM events",
    "streamed_versions": "SELECT id, count(DISTINCT content_sha256) AS events, 1::BIGINT AS new FROM evidence_snapshot WHERE content_sha256 IS NOT NULL GROUP BY 1",
}
ORACLES["streamed_health"] = ORACLES["user_health"]
ORACLES["json_answers"] = ORACLES["event_props"]
