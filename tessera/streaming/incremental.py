"""The incremental index as a stream: batches of changed files are upserted, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import language_of
from tessera.operators.extract import extract_files
from tessera.sources.store import Store, changed_files


def upsert_batch(store: Store, files: DataFrame) -> int:
    """Indexes a batch of (path, content); the latest of a path stays. Files that are stored with the same hash are passed over, so a replay changes nothing. Returns how many were indexed."""
    named = files.select("path", "content", language_of(F.col("path")).alias("language"), F.sha1("content").alias("blob_sha")).filter("language IS NOT NULL").dropDuplicates(["path"])
    changed = changed_files(named.withColumnRenamed("path", "file_path"), store.read("manifest")).withColumnRenamed("file_path", "path")
    from tessera.runtime import materialize

    changed = materialize(changed, "changed-files")
    n = changed.count()
    if n:
        symbols = materialize(extract_files(changed), "symbols")
        counts = symbols.groupBy("file_path").agg(F.count("*").cast("int").alias("symbol_count"))
        manifest = changed.select(F.col("path").alias("file_path"), "blob_sha", "language").join(counts, "file_path", "left").select("file_path", "blob_sha", "language", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.current_timestamp().alias("indexed_at"))
        new_symbols, new_manifest = store.upsert_files(symbols, manifest)
        store.commit(symbols=new_symbols, manifest=new_manifest)
    return n


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Starts a query that indexes what lands in the folder, and ends when all of it is done.

    Spark's file stream passes over names that begin with _ or a dot and over empty files; Engine.index finds these too.
    """
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    home = folder.rstrip("/").removeprefix("file://")
    named = raw.select(F.regexp_replace("path", rf"^(?:file:)?/*{home.lstrip('/')}/", "").alias("path"), "content")
    return named.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: upsert_batch(store, batch) and None).start()
