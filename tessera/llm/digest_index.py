"""Exact dedup against a persistent index of digests, bucketed and sorted by digest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.storage import fresh, materialize, shared_path


def digest(text):
    """SHA-256 of the text's bytes; null for null."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


class DigestIndex:
    """A table (digest, doc_id) at a shared path, in hash buckets sorted by digest.

    Opening the path again, in this or a later session, finds what was
    appended before. The anti-join of new digests reads it without shuffling
    it; only the new rows move. ``compact`` leaves one sorted file a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        self._register()

    def _register(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, doc_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Adds (digest, doc_id) rows in one write; a failed job leaves no part of them."""
        rows.select(F.col("digest"), F.col("doc_id").cast("long")).write.insertInto(self.name)

    def close(self) -> None:
        """Takes the table out of the catalog; its files stay, so that the path can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compact(self, target: str) -> DigestIndex:
        """A copy at another path with one sorted file in each bucket."""
        other = DigestIndex(self.spark, target, self.buckets)
        other.append(self.table().repartition(self.buckets, "digest"))
        return other


def least_rows(docs: DataFrame, name: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(name, row) of each different text: its digest, and as a struct of docs' columns the row of least key (null last).

    Rows alike in text and key are ordered by their other columns, nulls first, so the result hangs on the rows alone. Copies are reduced
    before they are shuffled: a text that a third of all rows hold sends one row from each task. Null texts have none.
    """
    # columns that have no order, such as maps, do not break ties
    ordered = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (text, key) and f.dataType.typeName() not in ("map", "variant", "void")]
    rank = F.struct(F.col(key).isNull(), F.col(key), *ordered)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.filter(F.col(text).isNotNull()).groupBy(digest(F.col(text)).alias(name)).agg(F.min_by(row, rank).alias("row"))


def first_of_each(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the copies of a text that docs or the index hold; what stays is appended to the index.

    Of each text that the index (by default a new, empty one in the shared folder) lacks the row of least key stays, a null key
    comes last; of rows alike in text and key the one whose other columns are least. Columns are as they were. Null texts equal nothing, are
    not indexed and all stay; empty texts are copies of one another; a very long text is as good as another; an empty table stays empty.
    """
    spark = docs.sparkSession
    own = index or DigestIndex(spark, shared_path(spark, "digest-index"))
    d = fresh(docs, "digest")[0]
    new = least_rows(docs, d, text, key)
    known = own.table().select(F.col("digest").alias(d))
    kept = materialize(new.hint("merge").join(known.hint("merge"), d, "left_anti").select(d, "row.*"), "first-rows")
    own.append(kept.select(F.col(d).alias("digest"), F.col(key).cast("long").alias("doc_id")))
    if index is None:
        own.close()
    return kept.drop(d).unionByName(docs.filter(F.col(text).isNull()))


def ingest(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Deduplicates docs (doc_id, text) in themselves and against the index, appends what is new, and returns it.

    The result has doc_id and digest (hexadecimal): of each text that the index
    lacked the row of least doc_id (null last). Texts that are null are
    not indexed and not returned. An empty table appends nothing. Columns other
    than the two are ignored.
    """
    new = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")).filter("digest IS NOT NULL")
    new = new.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = index.table().select("digest")
    fresh_rows = new.hint("merge").join(known.hint("merge"), "digest", "left_anti")
    added = materialize(fresh_rows, "appended")
    index.append(added)
    return added.select("doc_id", F.lower(F.hex("digest")).alias("digest"))


def ingest_in_turns(docs: DataFrame, index: DigestIndex, turns: int = 2) -> DataFrame:
    """What ingest returns for each of ``turns`` batches that together are docs, in order of doc_id (nulls in the last).

    Batches are ranges of doc_id of equal width, so a text is represented by its least doc_id, however many the turns; every
    batch but the first meets an index that holds those before. An empty index at the start is filled by the first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    edges = [low + (high - low + 1) * k // turns for k in range(1, turns)] if low is not None else []
    added = None
    for k in range(len(edges) + 1):
        inside = F.lit(True)
        if k:
            inside = inside & (F.col("doc_id") >= edges[k - 1])
        if k < len(edges):
            inside = inside & (F.col("doc_id") < edges[k])
        batch = ingest(docs.filter(inside if k < len(edges) else inside | F.col("doc_id").isNull()), index)
        added = batch if added is None else added.unionByName(batch)
    return added
