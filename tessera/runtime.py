"""What the library does to a session, and where operators keep tables that must outlive a lost executor."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application; the driver serves the archive."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    target = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can read.

    Where the setting is absent a folder of this machine is used, and only in
    local mode: on a cluster its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    context.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read back: the lineage ends there. ``release`` removes it unless it is to be kept."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    if not keep:
        _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that this application's operators wrote, and returns their number; results not yet read are lost with them."""
    gone = 0
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has such a column already (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
