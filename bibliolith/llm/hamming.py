"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into m segments. If two codes differ in at most m (r + 1) - 1 bits, some segment differs in at most
r bits, so probing each segment's buckets at radius 0, 1, ..., r finds all of them. Radii grow until the k-th distance is
covered by that bound; a query that is settled drops out of the later rounds. An upper bound of the k-th distance, first
from a bounded sample of codes and then from what was found, keeps candidates that can't matter out of the join's output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_partitions

BITS = 64
#: Segments for up to so many distinct codes (buckets then hold some hundreds at most), and beyond.
FEW_CODES, SEGMENTS_FEW, SEGMENTS_MANY = 1 << 20, 8, 4
#: Codes in the sample that bounds the k-th distance.
SAMPLE = 4_096


def sign_code(vector: Column) -> Column:
    """The signs of the first 64 components as a long: bit i is set where component i is above 0; missing ones are not."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(BITS)), F.lit(0).cast("long"))


def _segment(code: Column, s: int, width: int) -> Column:
    return F.shiftrightunsigned(code, width * s).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _first_found(code: Column, query: Column, seg: Column, radius: int, segments: int) -> Column:
    """Is this segment, at this radius, the first place where the pair is found? Then each pair comes up once in all rounds."""
    apart = [F.bit_count(_segment(code.bitwiseXOR(query), s, BITS // segments)) for s in range(segments)]
    never_before = reduce(lambda a, b: a & b, (d >= radius for d in apart))
    return never_before & reduce(lambda a, b: a & b, ((F.lit(s) >= seg) | (d > radius) for s, d in enumerate(apart)))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows of `codes` (vec_id, code) nearest to each row of `queries` (query_id, code).

    Ties in distance go by vec_id. Fewer than k rows give as many as there are. Null codes are neither found nor
    searched for; null ids are ignored; rows that repeat an id and a code count once. Equal codes share one index entry that keeps the k
    least ids (chosen in two salted steps), which is all that a top k can need.
    """
    spark = codes.sparkSession
    known = codes.where("vec_id is not null and code is not null").select("vec_id", "code").distinct()
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(max(16, shuffle_partitions(spark)))).alias("salt")
    some = known.select("vec_id", "code", salt).withColumn("n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("vec_id"))).where(F.col("n") <= k)
    ids = some.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k).groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(ids, "mih-codes")
    segments = SEGMENTS_FEW if entries.count() <= FEW_CODES else SEGMENTS_MANY
    width = BITS // segments
    tables = F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), _segment(F.col("code"), s, width).alias("val")) for s in range(segments))))
    index = materialize(entries.select("code", F.size("ids").alias("n"), F.col("ids")[0].alias("least"), tables.alias("t")).select("t.seg", "t.val", "code", "n", "least"), "mih-index")
    asked = queries.where("query_id is not null and code is not null").select("query_id", F.col("code").alias("query")).distinct()
    asked = materialize(asked, "mih-queries")
    sample = entries.orderBy(F.xxhash64("code")).limit(SAMPLE).agg(F.collect_list("code").alias("sample"))  # one row
    apart = F.array_sort(F.transform("sample", lambda c: _distance(c, F.col("query"))))
    active = asked.select("query").distinct().join(F.broadcast(sample)).select("query", F.coalesce(F.get(apart, F.lit(k - 1)), F.lit(BITS)).alias("kth"))
    active = materialize(active, "mih-active")
    best: DataFrame | None = None
    done: list[DataFrame] = []
    for radius in range(width + 1):
        flips = F.expr(f"filter(sequence(0, {(1 << width) - 1}), x -> bit_count(x) = {radius})")
        probes = active.select("query", "kth", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), _segment(F.col("query"), s, width).alias("own")) for s in range(segments)))).alias("p"))
        probes = probes.select("query", "kth", "p.seg", "p.own", F.explode(flips).alias("flip")).select("query", "kth", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("val"))
        found = probes.alias("p").hint("merge").join(
            index.alias("i"),
            (F.col("p.seg") == F.col("i.seg")) & (F.col("p.val") == F.col("i.val")) & (_distance(F.col("code"), F.col("query")) <= F.col("kth"))
            & _first_found(F.col("code"), F.col("query"), F.col("p.seg"), radius, segments),
        ).select("query", "code", "n", "least", _distance(F.col("code"), F.col("query")).alias("distance"))
        both = found if best is None else found.unionByName(best.join(active.select("query"), "query", "left_semi"))
        nearest = Window.partitionBy("query").orderBy("distance", "least")
        ranked = both.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).drop("r")
        now = materialize(ranked, "mih-best")
        # rows within the bound are final; the k-th distance so far limits what later rounds need to see
        bound = segments * (radius + 1) - 1
        so_far = now.withColumn("sum", F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
        kth = so_far.groupBy("query").agg(F.min(F.when(F.col("sum") >= k, F.col("distance"))).alias("found"))
        state = active.join(kth, "query", "left").select("query", F.least("kth", "found").alias("kth"))
        left = materialize(state.where(F.col("kth") > bound), "mih-active")
        done.append(now.join(left.select("query"), "query", "left_anti"))
        best, active = now, left
        if left.isEmpty():
            break
    else:
        done.append(best.join(active.select("query"), "query", "left_semi"))
    final = reduce(DataFrame.unionByName, done)
    rows = final.join(entries, "code").select("query", "distance", F.explode("ids").alias("vec_id"))
    rows = asked.join(rows, "query").withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("distance").cast("long").alias("distance"))
