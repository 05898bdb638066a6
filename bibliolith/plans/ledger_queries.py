"""Ledger, activity and streaming-shaped queries over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..schema import rounded
from ..streaming import events as stream
from .standins import table, view

_USAGE = """SELECT event_id AS id, event_type AS context, CAST(user_id AS STRING) AS model, CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(event_id % 50 AS BIGINT) AS completion_tokens,
    CAST(event_id % 7 AS BIGINT) AS cache_hit_tokens, ts AS created_at, 0.0e0 AS cost FROM events"""
_JOBS = "SELECT o_orderkey AS id, o_custkey AS doi, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'pending' ELSE 'done' END AS status, o_orderpriority AS level, o_totalprice AS value_score, CAST(CAST(substring(o_orderpriority, 1, 1) AS INT) AS BIGINT) AS priority, o_orderdate AS started_at, CASE WHEN o_orderkey % 9 = 0 THEN concat('e', CAST(o_orderkey AS STRING)) ELSE '' END AS error FROM orders"


def usage_summary(spark, sf):
    u = view(spark, sf, _USAGE)
    cost = ledger.call_cost(F.col("prompt_tokens"), F.col("cache_hit_tokens"), F.col("completion_tokens"), 2.0, 0.5, 8.0)
    s = ledger.usage_summary(u.withColumn("cost", cost), ["context"])
    return s.withColumn("cost", rounded(F.col("cost"), 6))


def usage_alerts(spark, sf):
    u = view(spark, sf, _USAGE).withColumn("context", F.concat_ws(":", "context", "model"))
    return ledger.busy_contexts(u, 5)


def query_cache_keys(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", ledger.cache_key(F.col("text")).alias("key"))


def answer_cache_keys(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", ledger.answer_key([F.col("role"), F.lit("v1 !")]).alias("key"))


def cache_live(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("created_at"))
    latest = e.agg(F.max("created_at").alias("now"))
    return ledger.live_entries(e.crossJoin(F.broadcast(latest)), F.col("now"), 24).select("id", "key")


def cache_evict(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_id") % 3).alias("hits"))
    return ledger.evict(e, 900, 0.1).select("id")


def job_queue_head(spark, sf):
    return ledger.queue_head(view(spark, sf, _JOBS), 20).select("id", "priority", "value_score")


def jobs_by_document(spark, sf):
    j = ledger.jobs_by_document(view(spark, sf, _JOBS))
    return j.select("doi", F.array_join("done", ",").alias("done"), F.array_join("queued", ",").alias("queued"), F.coalesce("error", F.lit("")).alias("error"))


def dead_letter_backoff(spark, sf):
    f = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("doi"), F.col("event_type").alias("op"), F.col("event_id").cast("double").alias("created"))
    return ledger.retry_schedule(f).select("doi", "op", "tries", "next_try")


def event_ring(spark, sf):
    return ledger.ring(table(spark, sf, "events"), 500).select("event_id")


def event_ring_by_kind(spark, sf):
    return ledger.ring(table(spark, sf, "events"), 50, "event_type").select("event_type", "event_id")


def activity_days(spark, sf):
    return ledger.activity(table(spark, sf, "events"), "day")


def activity_months(spark, sf):
    return ledger.activity(table(spark, sf, "events"), "month")


def batches_of_n(spark, sf):
    return ledger.in_batches(table(spark, sf, "customer"), "c_custkey", F.col("c_custkey").cast("string"), 50)


def session_stats(spark, sf):
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), "role", "text")
    return ledger.sessions(m).select("session", "messages", "tokens", F.coalesce("opening", F.lit("")).alias("opening"))


def stream_activity(spark, sf):
    return stream.run_batchwise(spark, sf, lambda df: stream.counts_by_window(df, "1 hour", "10 minutes"), "stream_activity", "complete").select("start", "event_type", "n")


def stream_usage_alerts(spark, sf):
    return stream.run_batchwise(spark, sf, lambda df: stream.busy_keys(df, "user_id", 5), "stream_alerts", "complete")


QUERIES = {
    f.__name__: f
    for f in (
        usage_summary, usage_alerts, query_cache_keys, answer_cache_keys, cache_live, cache_evict, job_queue_head, jobs_by_document, dead_letter_backoff, event_ring, event_ring_by_kind, activity_days,
        activity_months, batches_of_n, session_stats, stream_activity, stream_usage_alerts,
    )
}

ORACLE_SQL = {
    "usage_summary": f"""WITH u AS ({_USAGE}) SELECT context, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cache_hit_tokens) AS BIGINT) AS cache_hit_tokens,
        CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, floor(sum((greatest(0, prompt_tokens - cache_hit_tokens) * 2.0e0 + cache_hit_tokens * 0.5e0 + completion_tokens * 8.0e0) / 1e6) * 1000000 + 0.5) / 1000000.0 AS cost FROM u GROUP BY 1""",
    "usage_alerts": f"WITH u AS ({_USAGE}) SELECT id, concat(context, ':', model) AS context, CAST(row_number() OVER (PARTITION BY context, model ORDER BY created_at, id) AS BIGINT) AS nth FROM u QUALIFY nth > 5",
    "query_cache_keys": "SELECT item_id, substr(sha256(lower(trim(text))), 1, 16) AS key FROM benchmark",
    "answer_cache_keys": "SELECT conv_id, turn, substr(sha256(concat(lower(role), '|v1')), 1, 16) AS key FROM conversations",
    "cache_live": "WITH l AS (SELECT event_id AS id, user_id AS key, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT id, key FROM l WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR",
    "cache_evict": """SELECT event_id AS id FROM events QUALIFY (SELECT count(*) FROM events) <= 900 OR row_number() OVER (ORDER BY ts, event_id % 3, event_id) > greatest(1, CAST(floor((SELECT count(*) FROM events) * 0.1) AS BIGINT))""",
    "job_queue_head": f"WITH j AS ({_JOBS.replace('substring(', 'substr(')}) SELECT id, priority, value_score FROM j WHERE status IN ('queued', 'pending') ORDER BY priority DESC, value_score DESC, started_at, id LIMIT 20",
    "jobs_by_document": f"""WITH j AS ({_JOBS.replace('substring(', 'substr(')}) SELECT doi, coalesce(string_agg(DISTINCT level, ',' ORDER BY level) FILTER (status = 'done'), '') AS done, coalesce(string_agg(DISTINCT level, ',' ORDER BY level) FILTER (status = 'queued'), '') AS queued,
        coalesce(last(error ORDER BY started_at, id) FILTER (error <> ''), '') AS error FROM j GROUP BY 1""",
    "dead_letter_backoff": "SELECT CAST(user_id AS VARCHAR) AS doi, event_type AS op, count(*) AS tries, max(CAST(event_id AS DOUBLE)) + least(300 * pow(2.0, count(*) - 1), 86400.0) AS next_try FROM events GROUP BY 1, 2",
    "event_ring": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "event_ring_by_kind": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50",
    "activity_days": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "activity_months": "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS period, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "batches_of_n": "WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) SELECT CAST((rn - 1) // 50 AS BIGINT) AS batch, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ' OR ' ORDER BY c_custkey) AS joined FROM n GROUP BY 1",
    "session_stats": "SELECT conv_id AS session, count(*) AS messages, CAST(sum(greatest(1, length(text) // 2)) AS BIGINT) AS tokens, coalesce(first(text ORDER BY turn) FILTER (role = 'user'), '') AS opening FROM conversations GROUP BY 1",
    "stream_activity": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_usage_alerts": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 5",
}
