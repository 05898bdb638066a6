"""Named queries as tools, and plugins that add functions and queries to a session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Plugin:
    """What a plugin brings: SQL functions (name, function, return type) and queries; `on_register` is called with the session once."""

    name: str
    version: str = "0"
    functions: dict[str, tuple[Callable, str]] = field(default_factory=dict)
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    on_register: Callable[[SparkSession], None] | None = None
    enabled: bool = True


class Registry:
    """Plugins by name. Enabled ones offer their queries; a name that is taken is refused."""

    def __init__(self, queries: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None):
        self.own, self.plugins = dict(queries or {}), {}

    def register(self, spark: SparkSession, plugin: Plugin) -> None:
        taken = {plugin.name} & set(self.plugins) | set(plugin.queries) & set(self.tools())
        if taken:
            raise ValueError(f"names taken: {sorted(taken)}")
        for name, (function, kind) in plugin.functions.items():
            spark.udf.register(name, function, kind)
        if plugin.on_register:
            plugin.on_register(spark)
        self.plugins[plugin.name] = plugin

    def enable(self, name: str, on: bool = True) -> None:
        self.plugins[name].enabled = on

    def tools(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        """Every query by name: the library's own and those of enabled plugins."""
        out = dict(self.own)
        for p in self.plugins.values():
            out.update(p.queries if p.enabled else {})
        return out

    def call(self, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.tools()[name](spark, sf_dir)


class VectorIndex:
    """Where chunks are looked up: `none` finds nothing, `exact` compares with every vector."""

    def __init__(self, kind: str = "none", vectors: DataFrame | None = None):
        self.kind, self.vectors = kind, vectors

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        from .operators.vector import nearest

        found = nearest(self.vectors if self.vectors is not None else queries.withColumnRenamed("query_id", "vec_id"), queries, k)
        return found if self.kind == "exact" else found.limit(0)


def retried(attempt: Callable[[DataFrame], DataFrame], rows: DataFrame, key: str, most: int = 5) -> tuple[DataFrame, int]:
    """Rounds over what is still open until all is done or a round gets nowhere: (results, rounds). `attempt` returns the rows that it could do."""
    from .scratch import materialize

    done, open_, rounds = None, rows, 0
    left = open_.count()
    while left and rounds < most:
        rounds += 1
        got = materialize(attempt(open_), "retry-round")
        done = got if done is None else done.unionByName(got)
        open_ = materialize(open_.join(got.select(key), key, "left_anti"), "retry-open")
        now = open_.count()
        if now == left:
            break
        left = now
    return (done if done is not None else rows.limit(0)), rounds


def recover(tasks: DataFrame) -> DataFrame:
    """`tasks` after a restart: what was running when the process ended is queued again, with one more try."""
    from pyspark.sql import functions as F

    lost = F.col("status").isin("running", "compiling")
    return tasks.withColumn("tries", F.when(lost, F.col("tries") + 1).otherwise(F.col("tries"))).withColumn("status", F.when(lost, "queued").otherwise(F.col("status")))
