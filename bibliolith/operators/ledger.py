"""Operational ledgers: usage and cost, caches with expiry, queues, retries, event rings, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize, shuffle_partitions


def call_cost(prompt: Column, hit: Column, completion: Column, price_in: float, price_cached: float, price_out: float) -> Column:
    """Cost of a call at prices per million tokens; cached prompt tokens have their own price."""
    miss = F.greatest(F.lit(0), prompt - hit)
    return (miss * price_in + hit * price_cached + completion * price_out) / 1e6


def usage_summary(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    grouped = usage.groupBy(*by) if by else usage.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("calls"), zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"), zero("cache_hit_tokens").alias("cache_hit_tokens"),
        (zero("prompt_tokens") + zero("completion_tokens")).alias("total_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    )


def busy_contexts(usage: DataFrame, limit: int = 5) -> DataFrame:
    """Calls beyond the limit of their context, in order."""
    w = Window.partitionBy("context").orderBy("created_at", "id")
    return usage.withColumn("nth", F.row_number().over(w).cast("bigint")).where(F.col("nth") > limit).select("id", "context", "nth")


def cache_key(text: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text)).cast("binary"), 256), 1, 16)


def answer_key(parts: list[Column]) -> Column:
    """Parts without white space and punctuation, joined and hashed."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.regexp_replace(F.lower(p), r"(?U)[\s\W_]", "") for p in parts)).cast("binary"), 256), 1, 16)


def live_entries(cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The latest entry of each key that has not expired."""
    w = Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("id"))
    return cache.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").where(F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours)))


def evict(cache: DataFrame, capacity: int, share: float = 0.1) -> DataFrame:
    """Beyond `capacity`, the oldest and least used tenth goes."""
    n = cache.count()
    if n <= capacity:
        return cache
    gone = cache.orderBy("created_at", "hits", "id").limit(max(1, int(n * share))).select("id")
    return cache.join(gone, "id", "left_anti")


def queue_head(jobs: DataFrame, n: int = 1) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "pending")).orderBy(F.desc("priority"), F.desc("value_score"), "started_at", "id").limit(n)


def retry_schedule(failures: DataFrame, base: float = 300.0, cap: float = 86_400.0) -> DataFrame:
    """Per (doi, op): tries, the last failure, and when to try again: base * 2 ** (tries - 1) seconds later, at most `cap`."""
    g = failures.groupBy("doi", "op").agg(F.count(F.lit(1)).alias("tries"), F.max("created").alias("last"))
    return g.withColumn("next_try", F.col("last") + F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("tries") - 1), F.lit(cap)))


def due(schedule: DataFrame, now: float) -> DataFrame:
    return schedule.where(F.col("next_try") <= now)


def ring(events: DataFrame, size: int = 500, group: str | None = None) -> DataFrame:
    """The newest `size` events, of each group if one is named."""
    if group is None:
        return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(size)
    w = Window.partitionBy(group).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def activity(events: DataFrame, unit: str = "day") -> DataFrame:
    return events.groupBy(F.date_trunc(unit, "ts").alias("period"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 over the whole table in order, without a single task for all rows: ranges are numbered apart and moved on by the counts before them."""
    ranged = materialize(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_rn_", own).join(F.broadcast(before), "_p").withColumn(name, F.col("_rn_") + F.col("_before")).drop("_p", "_rn_", "_before")


def in_batches(df: DataFrame, order: str, value: Column, size: int = 50, join: str = " OR ") -> DataFrame:
    """(batch, n, joined): values in order, `size` to a batch."""
    n = numbered(df.select(F.col(order).alias("_o"), value.alias("_v")), ["_o"], "_rn")
    g = n.groupBy(F.floor((F.col("_rn") - 1) / size).cast("bigint").alias("batch"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]), join).alias("joined"))


def jobs_by_document(jobs: DataFrame) -> DataFrame:
    """Levels done, queued and stale of each document, and its latest error."""
    levels = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("level"))))
    return jobs.groupBy("doi").agg(levels("done").alias("done"), levels("queued").alias("queued"), levels("stale").alias("stale"), F.max_by("error", F.when(F.col("error") != "", F.struct("started_at", "id"))).alias("error"))


def sessions(messages: DataFrame) -> DataFrame:
    """Messages, tokens and the first user text of each session."""
    return messages.groupBy("session").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 2))).alias("tokens"), F.min_by("text", F.when(F.col("role") == "user", F.col("id"))).alias("opening"))


def diary_days(sources: dict[str, DataFrame]) -> DataFrame:
    """(day, a column of counts for each source, total) of several event sources, each with ts."""
    from functools import reduce

    rows = reduce(DataFrame.union, [df.select(F.to_date("ts").alias("day"), F.lit(name).alias("kind")) for name, df in sources.items()])
    days = rows.groupBy("day").pivot("kind", list(sources)).agg(F.count(F.lit(1)))
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in sources]
    out = days.select("day", *counts)
    return out.withColumn("total", reduce(lambda a, b: a + b, (F.col(c) for c in sources)))


def diary_months(days: DataFrame) -> DataFrame:
    """(month, days, and the sums) of diary days."""
    sums = [F.sum(c).alias(c) for c in days.columns if c != "day"]
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("days"), *sums)


def resolved(failures: DataFrame, done: DataFrame) -> DataFrame:
    """Failures with those of the (doi, op) in `done` marked as resolved."""
    marked = failures.join(done.select("doi", "op").distinct().withColumn("_done", F.lit(1)), ["doi", "op"], "left")
    return marked.withColumn("resolved", F.coalesce("_done", "resolved")).drop("_done")


def query_vectors(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """(query_id, key, vector): the cached vector (key, vector, hits) of each query by the MD5 of its trimmed text, null where it must be computed."""
    asked = queries.select("query_id", F.md5(F.trim("query").cast("binary")).alias("key"))
    return asked.join(cache.select("key", "vector"), "key", "left").select("query_id", "key", "vector")


def count_hits(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """The cache with the hits of a batch of keys added."""
    n = asked.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    return cache.join(n, "key", "left").withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0))).drop("_n")
