"""Upserts, fill-only merges, de-duplication and reconciliation as joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import filled


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """Whole-row replace by key; in a batch the last by `order` wins. The result tells new keys by is_new."""
    batch = first_by(new, [key], order) if order else new.dropDuplicates([key])
    known = batch.join(old.select(key), key, "left_semi").withColumn("is_new", F.lit(False))
    return old.join(batch.select(key), key, "left_anti").withColumn("is_new", F.lit(False)).unionByName(known).unionByName(batch.join(old.select(key), key, "left_anti").withColumn("is_new", F.lit(True)))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert if absent: what is there stays, and the first of a batch wins."""
    return old.unionByName(first_by(new, keys, order).join(old.select(*keys), keys, "left_anti"))


def replace_group(old: DataFrame, new: DataFrame, group: str, keys: list[str], order: list) -> DataFrame:
    """Delete all rows of the groups in the batch, then insert it; the last by `order` wins."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(first_by(new, keys, order))


def fill_only(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill empty texts ('' or null) and zero or null numbers from `new`, never overwriting; unknown keys of `new` are ignored."""
    kinds = dict(old.dtypes)

    def merged(c: str) -> Column:
        have = filled(F.col(f"o.{c}")) if kinds[c] == "string" else F.when(F.col(f"o.{c}") != 0, F.col(f"o.{c}"))
        return F.coalesce(have, F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)

    joined = old.alias("o").join(new.select(key, *columns).alias("n"), key, "left")
    return joined.select(*(F.col(key) if c == key else merged(c) if c in columns else F.col(f"o.{c}") for c in old.columns))


def keep_owned(old: DataFrame, new: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """Whole-row replace that keeps an owned column where the incoming one is empty."""
    both = new.alias("n").join(old.alias("o"), key, "left")
    row = both.select(*(F.coalesce(filled(F.col(f"n.{c}")), F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in owned else F.col(key) if c == key else F.col(f"n.{c}") for c in new.columns))
    return old.join(new.select(key), key, "left_anti").unionByName(row)


def three_tier(records: DataFrame, store: DataFrame, position: str = "position") -> DataFrame:
    """Records that are new: not in the store by doi, then first per doi, per title and year, and per first author, year and journal.

    Each tier sees the survivors of the one before. Records without a tier's key pass it.
    """
    rest = records.join(store.select("doi").where("doi <> ''").distinct(), "doi", "left_anti")
    for has, keys in (("doi <> ''", ["doi"]), ("title <> '' and year <> ''", ["title", "year"]), ("surname <> '' and year <> '' and journal <> ''", ["surname", "year", "journal"])):
        tagged = rest.withColumn("_has", F.expr(has))
        rest = first_by(tagged.where("_has"), keys, [F.col(position)]).unionByName(tagged.where(~F.col("_has"))).drop("_has")
    return rest


def absorb(store: DataFrame, records: DataFrame, key: str, columns: list[str], position: str = "position") -> DataFrame:
    """The store with its empty columns filled by records of the same key, from the first that has a value."""
    kinds = dict(store.dtypes)
    there = {c: F.col(c).isNotNull() & (F.col(c) != ("" if kinds[c] == "string" else 0)) for c in columns}
    found = records.groupBy(key).agg(*(F.min_by(c, F.when(there[c], F.col(position))).alias(c) for c in columns))
    return fill_only(store, found, key, columns)


def by_priority(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Per key and column, the first non-empty value in order of the sources: one union and one aggregation."""
    tagged = [s.select(key, F.lit(i).alias("_p"), *columns) for i, s in enumerate(sources)]
    everything = reduce(DataFrame.unionByName, tagged)
    return everything.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c) != "", F.col("_p"))).alias(c) for c in columns))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, reason): what one side has and the other lacks."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("reason", F.lit("left_only"))
    b = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("reason", F.lit("right_only"))
    return a.union(b)


def resolve(requests: DataFrame, by_rid: DataFrame, by_identifier: DataFrame, by_dirname: DataFrame, by_doi: DataFrame | None = None) -> DataFrame:
    """Resolve `name` to a rid: as a rid itself, then by identifier, then as a DOI by rule, then by directory name; `how` tells which.

    by_doi has doi and rid; names are compared with it in the plain form of DOIs.
    """
    from ..functions.text import doi as plain

    j = requests.join(by_rid.select(F.col("rid").alias("name"), F.col("rid").alias("r1")), "name", "left")
    j = j.join(by_identifier.select(F.col("value").alias("name"), F.col("rid").alias("r2")), "name", "left").join(by_dirname.select(F.col("dirname").alias("name"), F.col("rid").alias("r3")), "name", "left")
    j = j.withColumn("_doi", plain(F.col("name")))
    j = j.join(by_doi.select(plain(F.col("doi")).alias("_doi"), F.col("rid").alias("r4")).dropDuplicates(["_doi"]), "_doi", "left") if by_doi is not None else j.withColumn("r4", F.lit(None).cast("string"))
    how = F.when(F.col("r1").isNotNull(), "rid").when(F.col("r2").isNotNull(), "identifier").when(F.col("r4").isNotNull(), "doi").when(F.col("r3").isNotNull(), "dirname").otherwise("")
    return j.select("name", F.coalesce("r1", "r2", "r4", "r3", F.lit("")).alias("rid"), how.alias("how"))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def delete_down(gone: DataFrame, tables: list[tuple[DataFrame, str, str | None]]) -> list[DataFrame]:
    """What remains of a chain of tables (rows, key, key of the parent) when the first loses the keys in `gone`: every table loses the rows below lost ones."""
    out, lost = [], gone.toDF("_gone")
    for k, (rows, key, parent) in enumerate(tables):
        by = key if k == 0 else parent
        out.append(rows.join(lost, F.col(by) == F.col("_gone"), "left_anti"))
        lost = rows.join(lost, F.col(by) == F.col("_gone"), "left_semi").select(F.col(key).alias("_gone")).distinct()
    return out


def sync_columns(meta: DataFrame, identifiers: DataFrame, papers: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """`meta` (rid, doi, ...) brought up to date by papers (doi, ...): numbers where the paper has one, texts where it has a non-empty one.

    A document's doi is what `identifiers` (value, rid) names for its rid (the least, of several), else its own.
    """
    named = identifiers.groupBy("rid").agg(F.min("value").alias("_value"))
    keyed = meta.join(named, "rid", "left").withColumn("_doi", F.coalesce("_value", "doi"))
    source = papers.select(F.col("doi").alias("_doi"), *(F.col(c).alias(f"_{c}") for c in (*numbers, *texts))).dropDuplicates(["_doi"])
    joined = keyed.join(source, "_doi", "left")
    fresh = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in numbers} | {c: F.coalesce(filled(f"_{c}"), F.col(c)) for c in texts}
    return joined.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in meta.columns))


def compact(segments: DataFrame, key: str, version: str, deleted: str) -> DataFrame:
    """The live rows of an append-only table: the latest version of each key, unless that is a tombstone."""
    return first_by(segments, [key], [F.desc(version)]).where(~F.col(deleted))


def appended(segments: DataFrame, batch: DataFrame, key: str, version: str, deleted: str, gone: DataFrame | None = None) -> DataFrame:
    """An append-only table with a batch of rows and, for the keys in `gone`, tombstones: versions go on from the highest there is."""
    last = segments.agg(F.coalesce(F.max(version), F.lit(0)).alias("_last"))
    more = batch.withColumn(deleted, F.lit(False))
    if gone is not None:
        rest = [c for c in batch.columns if c != key]
        more = more.unionByName(gone.select(key, *(F.lit(None).cast(dict(batch.dtypes)[c]).alias(c) for c in rest)).withColumn(deleted, F.lit(True)))
    return segments.unionByName(more.crossJoin(F.broadcast(last)).withColumn(version, (F.col("_last") + 1).cast(dict(segments.dtypes)[version])).drop("_last").select(segments.columns))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str, meta: str) -> DataFrame:
    """(key, action): insert, refresh, meta_only, keep or delete."""
    j = old.select(key, F.col(content).alias("_oc"), F.col(meta).alias("_om")).join(new.select(key, F.col(content).alias("_nc"), F.col(meta).alias("_nm")), key, "full_outer")
    action = (
        F.when(F.col("_nc").isNull(), "delete").when(F.col("_oc").isNull(), "insert").when(F.col("_oc") != F.col("_nc"), "refresh")
        .when(~F.col("_om").eqNullSafe(F.col("_nm")), "meta_only").otherwise("keep")
    )
    return j.select(key, action.alias("action"))
