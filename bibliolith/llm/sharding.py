"""Sharding by minimax contiguous partition over ordered groups of equal texts.

The groups, ordered by the SHA-256 of their text, are cut into k contiguous runs so that the largest run is as small
as any contiguous cut allows. The smallest feasible capacity is found by binary search, each candidate checked by the
greedy walk. The driver never holds the groups: it walks *segments* (runs of keys with a common prefix, with their byte
sums); the few groups that outweigh a part of a shard are segments of their own from the start. Segments that could hold a
cut for any capacity still possible are split by further key digits until they are single groups, so the answer is that
of the full list of groups.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize, text_bytes, text_crc32

#: Key digits of the first segments, and digits added to a segment that is split.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Groups of more than this part of a shard's even share stand alone; there are at most `HEAVY_PART * shards` of them.
HEAVY_PART = 16


class Segment:
    """A run of groups from the key `first` to the key `last`, all those of one `part`: their bytes, and whether it is one group only."""

    __slots__ = ("first", "last", "part", "size")

    def __init__(self, first: str, last: str, size: int, part: str):
        self.first, self.last, self.size, self.part = first, last, size, part

    @property
    def atomic(self) -> bool:
        return self.first == self.last


def _prefix_sums(segments: list[Segment]) -> list[int]:
    out = [0]
    for s in segments:
        out.append(out[-1] + s.size)
    return out


def _walk(segments: list[Segment], sums: list[int], capacity: int, shards: int, fluid: bool) -> list[int] | None:
    """Cut positions in bytes of the greedy walk, or None if `shards` runs of `capacity` do not cover everything.

    fluid: segments of several groups can be cut at any byte, which no real cut can beat.
    """
    at, cuts = 0, []
    for _ in range(shards):
        if at == sums[-1]:
            break
        to = at + capacity
        if to >= sums[-1]:
            at = sums[-1]
        else:
            k = bisect_right(sums, to) - 1
            at = to if fluid and not segments[k].atomic else sums[k] if sums[k] > at else -1
            if at < 0:
                return None
        cuts.append(at)
    return cuts if at == sums[-1] else None


def _least(segments: list[Segment], sums: list[int], shards: int, fluid: bool) -> int:
    low, high = -(-sums[-1] // shards), sums[-1]
    low = max(low, 1)
    while low < high:
        mid = (low + high) // 2
        if _walk(segments, sums, mid, shards, fluid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _in_windows(segments: list[Segment], sums: list[int], low: int, high: int, shards: int) -> list[int]:
    """Segments of several groups in which a cut can fall for a capacity from `low` to `high`."""
    found, first, last = set(), 0, 0
    for _ in range(shards - 1):
        first = sums[max(0, bisect_right(sums, min(first + low, sums[-1])) - 1)] if first + low < sums[-1] else sums[-1]
        last = min(last + high, sums[-1])
        if last < sums[-1] and segments[k := bisect_right(sums, last) - 1].atomic:
            last = sums[k]  # no cut falls inside a group
        if first >= sums[-1]:
            break
        a, b = bisect_right(sums, first) - 1, bisect_right(sums, last) - 1
        found.update(k for k in range(max(0, a), min(b, len(segments) - 1) + 1) if not segments[k].atomic)
    return sorted(found)


def minimax_cuts(keyed: DataFrame, shards: int, key: str = "key", size: str = "size") -> list[str]:
    """The first key of shard 1, 2, ... (fewer if the groups fill fewer shards); `key` is a hex string."""

    total = keyed.agg(F.sum(size).alias("n")).first().n or 0
    heavy = keyed.groupBy(key).agg(F.sum(size).alias("s")).where(F.col("s") * (HEAVY_PART * shards) > total).select(key)
    heavy = sorted(r[0] for r in heavy.collect())
    # the heavy keys at or before a key, and is it one of them
    before = F.size(F.filter(F.array(*map(F.lit, heavy)).cast("array<string>"), lambda h: h <= F.col(key)))
    zone = F.concat(before.cast("string"), F.when(F.col(key).isin(heavy), "h").otherwise("")) if heavy else F.lit("")

    def part(digits: int) -> Column:
        return F.concat(F.substring(key, 1, digits), F.lit("/"), zone)

    def split(rows: DataFrame, digits: int) -> list[Segment]:
        summed = rows.groupBy(part(digits).alias("p")).agg(F.sum(size).alias("s"), F.min(key).alias("a"), F.max(key).alias("b"))
        return [Segment(r.a, r.b, int(r.s), r.p) for r in summed.orderBy("a").collect()]

    segments = split(keyed, FIRST_DIGITS)
    digits = FIRST_DIGITS
    while segments:
        sums = _prefix_sums(segments)
        low, high = _least(segments, sums, shards, True), _least(segments, sums, shards, False)
        again = _in_windows(segments, sums, low, high, shards) if low < high else []
        if not again:
            cuts = _walk(segments, sums, high, shards, False)
            return [segments[bisect_right(sums, c) - 1].first for c in cuts if c < sums[-1]]
        digits += MORE_DIGITS
        parts = [segments[k].part for k in again]
        inside = reduce(lambda a, b: a | b, (part(n).isin([p for p in parts if p.index("/") == n]) for n in sorted({p.index("/") for p in parts})))
        finer = split(keyed.where(inside), digits)
        again_set = set(again)
        segments = sorted([s for k, s in enumerate(segments) if k not in again_set] + finer, key=lambda s: s.first)
    return []


def shard_of(key: Column, cuts: list[str]) -> Column:
    """The shard of a key: the number of cuts at or before it."""
    return reduce(lambda a, b: a + b, (F.when(key >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All rows of `docs` (doc_id, text, ...) with shard, slot and the size that counts; equal texts stay together.

    Sizes are UTF-8 bytes plus 1, so null and empty texts have size 1; null counts as a text of its own group. Repeated
    rows and repeated ids are numbered like any others. An empty table gives an empty result. Extra columns are ignored.
    One text that outweighs an even share sets the capacity, as groups are atomic.
    """
    keyed = docs.select(
        "doc_id",
        (text_bytes(F.col("text")) + 1).alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("0" * 64)).alias("key"),
    )
    keyed = materialize(keyed, "shard-keys")
    cuts = minimax_cuts(keyed, shards)
    placed = keyed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard_of(F.col("key"), cuts).alias("shard"), F.lit(None).cast("int").alias("grown_shard"))
    return gapless_rank(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
