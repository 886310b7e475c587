"""The persistent graph: Parquet tables in versioned folders behind one pointer file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import EDGES, LEASES, MANIFEST, POSTINGS, SYMBOLS, VECTORS, complete

TABLES = {"symbols": SYMBOLS, "edges": EDGES, "manifest": MANIFEST, "leases": LEASES, "postings": POSTINGS, "vectors": VECTORS}
#: Columns that folders are named by, so that scans prune.
FOLDERS = {"symbols": "language", "edges": "type", "postings": "part"}


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """current (file_path, blob_sha, ...) rows that the store lacks or has with another hash, with state new or changed."""
    s = stored.select("file_path", F.col("blob_sha").alias("_stored"))
    state = F.when(F.col("_stored").isNull(), "new").when(F.col("_stored") != F.col("blob_sha"), "changed")
    return current.join(s, "file_path", "left").withColumn("state", state).filter("state IS NOT NULL").drop("_stored")


def vanished_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path) in the store and not in current."""
    return stored.select("file_path").join(current.select("file_path"), "file_path", "left_anti")


class Store:
    """Tables under a folder that driver and executors share.

    The folder may be on any file system that Spark knows. A write makes a new version folder for the tables it replaces and then a
    new pointer, whose number is one higher: it is written under another name and renamed, which fails where that number is
    there already, so of two writers one gets an error and no reader sees half a write. Older pointers and versions are removed by ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda *parts: hadoop.Path("/".join((self.path, *parts)))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("pointers")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("pointers"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def exists(self) -> bool:
        return bool(self._versions())

    def _pointer(self) -> dict:
        versions = self._versions()
        if not versions:
            return {}
        stream = self._fs.open(self._at("pointers", f"{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, pointer: dict, version: int) -> None:
        temporary, target = self._at("pointers", f".{uuid.uuid4().hex}"), self._at("pointers", f"{version}.json")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            raise RuntimeError("another writer has committed; nothing was changed")

    def vacuum(self) -> int:
        """Removes all that the current pointer does not name, and returns how many folders went; readers of older snapshots lose them."""
        versions, pointer = self._versions(), self._pointer()
        for old in versions[:-1]:
            self._fs.delete(self._at("pointers", f"{old}.json"), False)
        gone = 0
        for name in TABLES:
            if self._fs.exists(self._at(name)):
                for x in self._fs.listStatus(self._at(name)):
                    if not pointer.get(name, "").endswith(f"/{x.getPath().getName()}"):
                        gone += bool(self._fs.delete(x.getPath(), True))
        return gone

    def read(self, name: str) -> DataFrame:
        """The table as last committed; empty where there is none. Columns that older files lack are filled in."""
        at = self._pointer().get(name)
        schema = TABLES[name]
        if at is None:
            return self.spark.createDataFrame([], schema)
        return complete(self.spark.read.option("mergeSchema", "true").parquet(at), schema)

    def commit(self, **tables: DataFrame) -> None:
        """Replaces the given tables together."""
        version = uuid.uuid4().hex
        last = (self._versions() or [0])[-1]
        pointer = self._pointer()
        for name, df in tables.items():
            target = f"{self.path}/{name}/{version}"
            writer = complete(df, TABLES[name]).write
            by = FOLDERS.get(name)
            (writer.partitionBy(by) if by else writer).parquet(target)
            pointer[name] = target
        self._point(pointer, last + 1)

    def upsert_files(self, symbols: DataFrame, manifest: DataFrame, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(symbols, manifest) with the files of ``manifest`` replaced by the new rows and those of ``gone`` left out."""
        touched = manifest.select("file_path")
        if gone is not None:
            touched = touched.unionByName(gone.select("file_path"))
        keep = lambda df: df.join(touched, "file_path", "left_anti")
        return keep(self.read("symbols")).unionByName(complete(symbols, SYMBOLS)), keep(self.read("manifest")).unionByName(complete(manifest, MANIFEST))
