"""Edge algebra: merging, synchronising and pruning edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_edges(edges: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One edge for each (src, dst, type): the most confident, the first by ``ordinal`` (else by source, reason) where equal. A missing source is 'unknown'."""
    order = F.struct(F.col("confidence"), -F.col(ordinal) if ordinal else F.struct(*(F.coalesce(F.col(c), F.lit("")) for c in ("source", "reason"))))
    kept = F.max_by(F.struct("confidence", "source", "reason"), order).alias("e")
    return edges.groupBy("src", "dst", "type").agg(kept).select("src", "dst", "type", "e.confidence", F.coalesce(F.when(F.col("e.source") != "", F.col("e.source")), F.lit("unknown")).alias("source"), F.coalesce("e.reason", F.lit("")).alias("reason"))


def first_wins(edges: DataFrame, ordinal: str) -> DataFrame:
    """The edge of least ordinal for each (src, dst)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), ordinal).alias("e")).select("src", "dst", *(f"e.{c}" for c in rest))


def sync(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, type, action): insert, update or delete, to make old into new; equal edges have no row."""
    keys = ["src", "dst", "type"]
    values = ("confidence", "source", "reason")
    a = old.select(*keys, F.struct(*values).alias("a"))
    b = new.select(*keys, F.struct(*values).alias("b"))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return a.join(b, keys, "full_outer").withColumn("action", action).filter("action IS NOT NULL").select(*keys, "action")


def carry_forward(native: DataFrame, skipped_languages: list[str], symbols: DataFrame) -> DataFrame:
    """Native edges of languages that were not analysed again, if both ends still exist as symbols."""
    ids = symbols.select("id", "language")
    kept = native.filter("source = 'native'").join(ids.filter(F.col("language").isin(*skipped_languages)).select(F.col("id").alias("src")), "src", "left_semi")
    return kept.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*native.columns)


def deps(edges: DataFrame, path: str, include_inbound: bool = False) -> DataFrame:
    """Edges that leave the file's node or touch one of its symbols."""
    own = f"{path}::"
    touch = (F.col("src") == f"file:{path}") | F.col("src").startswith(own) | F.col("dst").startswith(own)
    return edges.filter(touch | (F.col("dst") == f"file:{path}") if include_inbound else touch)


def division(have: DataFrame, need: DataFrame, owner: str, group: str, item: str) -> DataFrame:
    """(owner, group): owners whose items in ``have`` include all items of the group in ``need``."""
    need = need.select(group, item).distinct()
    size = need.groupBy(group).agg(F.count("*").alias("needed"))
    met = have.select(owner, item).distinct().join(need, item).groupBy(owner, group).agg(F.count("*").alias("met"))
    return met.join(size, group).filter("met = needed").select(owner, group)


def dedup_window(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")
