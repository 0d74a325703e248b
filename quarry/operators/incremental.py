"""Incremental maintenance and impact of changes: what to parse again, what to drop, which facts and paths are touched."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table written in the folder that the cluster shares."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/quarry-work"  # threads of one machine
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def changes(scanned: DataFrame, stored: DataFrame, version: int, full: bool = False, retry_failed: bool = False) -> DataFrame:
    """(path, change) of scanned (path, hash) against stored (path, hash, status, version): new, changed, unchanged, deleted.

    A file is parsed again if asked for in full, if its extractor version differs, if its hash does, or if it failed and
    failures are retried.
    """
    s = stored.select("path", F.col("hash").alias("_hash"), F.col("status").alias("_status"), F.col("version").alias("_version"), F.lit(True).alias("_stored"))
    both = scanned.withColumn("_scanned", F.lit(True)).join(s, "path", "full_outer")
    again = F.lit(full) | (F.col("_version") != version) | ~F.col("hash").eqNullSafe(F.col("_hash")) | (F.col("_status").isin("failed", "stale") & F.lit(retry_failed))
    change = F.when(F.col("_stored").isNull(), "new").when(F.col("_scanned").isNull(), "deleted").when(again, "changed").otherwise("unchanged")
    return both.select("path", "hash", change.alias("change"))


def protected(deleted: DataFrame, unreadable: list[str]) -> DataFrame:
    """Adds whether a deletion lies below a prefix that a scan could not read (a short list from that scan)."""
    below = reduce(lambda a, b: a | b, [F.col("path").startswith(p) for p in unreadable], F.lit(False))
    return deleted.withColumn("protected", below)


def protected_below(deleted: DataFrame, issues: DataFrame) -> DataFrame:
    """Paths of `deleted` that are issues (path) themselves or lie in a folder that is one; equal joins on every parent folder."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = deleted.select("path", F.explode(F.concat(above, F.array(F.lit("")))).alias("above"))
    return each.join(issues.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()


def affected(facts: DataFrame, key: str, keys: str, changed: DataFrame, own: Column) -> DataFrame:
    """Facts of which a dependency key (array `keys`) is among changed (key), or that fulfil `own`."""
    met = facts.select(key, F.explode(keys).alias("key")).join(changed.distinct(), "key", "left_semi").select(key)
    return met.union(facts.where(own).select(key)).distinct()


def replace_files(table: DataFrame, fresh: DataFrame, parsed: DataFrame, deleted: DataFrame, failed: DataFrame, by: str = "file_id") -> DataFrame:
    """A child table after a run: rows of parsed and deleted files go, fresh ones come; of failed files the last good ones stay."""
    gone = parsed.select(by).union(deleted.select(by)).distinct().join(failed.select(by), by, "left_anti")
    return table.join(gone, by, "left_anti").unionByName(fresh.join(failed.select(by), by, "left_anti"))


def risks(symbols: DataFrame, routes: DataFrame, schemas: DataFrame, tests: DataFrame, unrelated: DataFrame, truncated: bool, order: list[str]) -> DataFrame:
    """(code, relative_path) of a change's risks, from frames with a relative_path.

    Changed symbols without any related test, the first changed route and the first changed schema in `order`, every path
    outside what was expected, and a diff that was cut. A risk of the whole change has no path.
    """
    spark, nowhere = symbols.sparkSession, F.lit(None).cast("string").alias("relative_path")
    told = lambda code: F.lit(code).alias("code")
    some, none = symbols.limit(1).agg(F.count(F.lit(1)).alias("a")).where("a > 0"), tests.limit(1).agg(F.count(F.lit(1)).alias("b")).where("b = 0")
    parts = [some.crossJoin(F.broadcast(none)).select(told("missing_regression_test"), nowhere)]  # one row or none on either side
    for code, rows in (("route_contract_changed", routes), ("schema_contract_changed", schemas)):
        first = rows.agg(F.count(F.lit(1)).alias("n"), F.min_by("relative_path", F.struct(*order)).alias("relative_path")).where("n > 0")
        parts.append(first.select(told(code), "relative_path"))
    parts.append(unrelated.select(told("unrelated_change"), "relative_path").distinct())
    if truncated:
        parts.append(spark.range(1).select(told("analysis_truncated"), nowhere))
    return reduce(DataFrame.unionByName, parts)
