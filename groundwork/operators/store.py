"""Changes of stored tables as new tables: upserts, patches, deletes that cascade, and answers kept by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` with ``rows`` put in by key: of several rows of a key the last by ``order`` replaces the stored one."""
    rest = [c for c in stored.columns if c != key]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")
    return stored.join(last, key, "left_anti").unionByName(last)


def patch(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``stored`` with the given columns changed where ``changes`` (key, column, has_column) says so; a null that is given sets null. One change a key."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns], *[F.col(f"has_{x}").alias(f"_has_{x}") for x in columns])
    j = stored.join(c, key, "left")
    return j.select(*[F.when(F.coalesce(F.col(f"_has_{x}"), F.lit(False)), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in stored.columns])


def deleted(tables: dict[str, DataFrame], gone: DataFrame, root: str, links: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """The tables without the rows of ``root`` whose id is in ``gone`` (id), and without those that hang on them.

    ``links`` are (child table, its column, parent table), parents before their children.
    """
    dead = {root: gone.select("id").distinct()}
    for child, column, parent in links:
        if parent in dead:
            hit = tables[child].join(dead[parent].select(F.col("id").alias(column)), column, "left_semi").select("id").distinct()
            dead[child] = hit if child not in dead else dead[child].unionByName(hit).distinct()
    return {name: df.join(dead[name], "id", "left_anti") if name in dead else df for name, df in tables.items()}


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, status, response): requests beside the last answer (key, seq, status, response) kept for their key.

    ``reuse`` where it succeeded, ``unresolved`` where one was sent and its end isn't known, else ``dispatch``.
    """
    last = answers.groupBy("key").agg(F.max_by(F.struct("status", "response"), "seq").alias("a"))
    done = F.col("a.status") == "succeeded"
    status = F.when(done, "reuse").when(F.col("a.status") == "sent", "unresolved").otherwise("dispatch")
    return requests.select("key").distinct().join(last, "key", "left").select("key", status.alias("status"), F.when(done, F.col("a.response")).alias("response"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])
