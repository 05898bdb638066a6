"""Helpers shared by the training-data operators: distributed numbering, Arrow batches, word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, materialize, release_shuffles, scratch_dir, shuffle_partitions  # noqa: F401


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def gapless_rank(df: DataFrame, group: list[str], spread: list[Column], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without gathering a group in one task.

    Rows are spread over salt buckets by a hash of `spread`, counted per (group, bucket), and numbered within their
    bucket after the rows of the buckets before it. The result is stable as long as `order` orders equal-hash rows.
    """
    buckets = max(32, shuffle_partitions(df.sparkSession))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rn", F.row_number().over(within))
    return ranked.join(base, [*group, "_salt"]).withColumn(name, (F.col("_base") + F.col("_rn") - 1).cast("long")).drop("_salt", "_base", "_rn")


_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiplicative hash, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, _MULT), np.full(size, np.uint64(pow(int(_MULT), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of a uint8 array: equal bytes give equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(56))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where rows hold whole texts, so that a worker's memory is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        out.append((at, min(to, n)))
        at = out[-1][1]
    return out


def binary_batch(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as one byte array and the n + 1 offsets of its rows (null rows are empty)."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)
