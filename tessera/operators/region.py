"""Change regions, their conflicts, and leases."""

from __future__ import annotations

import base64
import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.search import lexical

LOCK_PREFIX = "tessera:lock:file:"


def intent_id(intent: str) -> str:
    return "icr-" + hashlib.sha1(intent.encode()).hexdigest()[:12]


def confidence(seeds):
    return F.when(seeds == 0, 0.2).when(seeds < 3, 0.65).when(seeds < 10, 0.8).otherwise(0.9)


def _hits_and_boundary(symbols: DataFrame, edges: DataFrame, intent: str, seeds: int) -> tuple[DataFrame, DataFrame]:
    found = lexical(symbols, intent, seeds) if intent.strip() else symbols.withColumn("rank", F.lit(0)).limit(0)
    hits = found.select("id", "file_path")
    files = hits.select("file_path").distinct()
    marked = edges.select("src", "dst", "type", F.explode(F.array_distinct(F.array(F.regexp_replace(F.substring_index("src", "::", 1), "^file:", ""), F.when(F.contains("dst", F.lit("::")), F.substring_index("dst", "::", 1))))).alias("file_path"))
    return hits, marked.join(F.broadcast(files), "file_path").select("src", "dst", "type").distinct()


def _claimed(hits: DataFrame) -> DataFrame:
    return hits.agg(F.array_sort(F.collect_set("id")).alias("exclusive"), F.array_sort(F.collect_set("file_path")).alias("exclusive_files"), F.count("*").alias("n"))


def isolated_region(symbols: DataFrame, edges: DataFrame, intent: str, seeds: int = 20) -> DataFrame:
    """One row: the region that an intent should change. An empty intent has an empty region.

    exclusive symbols are the intent's best lexical hits; their files are exclusive; boundary edges
    touch those files; shared reads are the ends of the boundary. The boundary is in the row: where
    its size is enough, region_size counts it.
    """
    hits, boundary = _hits_and_boundary(symbols, edges, intent, seeds)
    b = boundary.agg(F.array_sort(F.collect_set(F.concat_ws("::", "src", "type", "dst"))).alias("boundary"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("src", "dst"))))).alias("shared_read"))
    return _claimed(hits).crossJoin(b).select(
        F.lit(intent).alias("intent"), F.lit(intent_id(intent)).alias("intent_id"), "exclusive", "exclusive_files", F.col("exclusive_files").alias("readable_files"), "boundary", "shared_read",
        F.transform("exclusive_files", lambda f: F.concat(F.lit(LOCK_PREFIX), f)).alias("lock_keys"), confidence(F.col("n")).alias("confidence"),
    )


def region_size(symbols: DataFrame, edges: DataFrame, intent: str, seeds: int = 20) -> DataFrame:
    """One row (exclusive, exclusive_files, boundary, shared_read, confidence) as isolated_region has it, with the numbers of boundary edges and shared reads, which no task gathers."""
    hits, boundary = _hits_and_boundary(symbols, edges, intent, seeds)
    b = boundary.select(F.concat_ws("::", "src", "type", "dst")).distinct().agg(F.count(F.lit(1)).alias("boundary"))
    r = boundary.select(F.explode(F.array("src", "dst"))).distinct().agg(F.count(F.lit(1)).alias("shared_read"))
    return _claimed(hits).crossJoin(b).crossJoin(r).select("exclusive", "exclusive_files", "boundary", "shared_read", confidence(F.col("n")).alias("confidence"))


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the symbols and files that two regions both claim."""
    x, y = a.select(F.struct("exclusive", "exclusive_files").alias("a")), b.select(F.struct("exclusive", "exclusive_files").alias("b"))
    both = x.crossJoin(y).select(F.array_sort(F.array_intersect("a.exclusive", "b.exclusive")).alias("symbols"), F.array_sort(F.array_intersect("a.exclusive_files", "b.exclusive_files")).alias("files"))
    return both.withColumn("conflict", (F.size("symbols") > 0) | (F.size("files") > 0))


def decode_region(text: str) -> dict:
    """A region from JSON, or from JSON in base64."""
    try:
        return json.loads(text)
    except ValueError:
        return json.loads(base64.b64decode(text, validate=False))


def live(leases: DataFrame, now: datetime) -> DataFrame:
    return leases.filter(F.col("expires_at") > F.lit(now))


def blocked(leases: DataFrame, keys: DataFrame, intent: str, now: datetime) -> DataFrame:
    """Live leases of other intents on the keys (lock_key)."""
    return live(leases, now).filter(F.col("intent_id") != intent).join(keys.select("lock_key").distinct(), "lock_key", "left_semi")


def acquire(leases: DataFrame, keys: DataFrame, intent: str, now: datetime, ttl: timedelta = timedelta(minutes=30)) -> DataFrame | None:
    """The lease table with the keys held by the intent until now + ttl, or None if any is blocked. The caller must be the only writer."""
    if not blocked(leases, keys, intent, now).isEmpty():
        return None
    taken = keys.select("lock_key").distinct().select("lock_key", F.lit(intent).alias("intent_id"), F.lit(now).alias("acquired_at"), F.lit(now + ttl).alias("expires_at"))
    return leases.join(taken.select("lock_key"), "lock_key", "left_anti").unionByName(taken)


def release(leases: DataFrame, intent: str) -> DataFrame:
    """The lease table without the intent's leases."""
    return leases.filter(~F.col("intent_id").eqNullSafe(intent))
