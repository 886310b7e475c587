"""Structural diff of two snapshots of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank_identifier

IDENTITY = ("file_path", "qualified_name", "kind")
#: Bodies under so many bytes say too little to pair by.
LEAST_BODY = 24
#: Partial renames are looked for only among so few.
MOST_PARTIAL = 12


def diff(before: DataFrame, after: DataFrame, start: str = "span.start") -> DataFrame:
    """(change, breaking, before, after): added, removed and changed symbols as structs.

    Symbols pair by file, qualified name, kind and their position among those alike; a pair has changed where signature or text
    differ. Breaking: an exported symbol was removed or its signature changed.
    """
    order = Window.partitionBy(*IDENTITY).orderBy(F.col(start), "id")
    side = lambda df, name: df.withColumn("_n", F.row_number().over(order)).select(*IDENTITY, "_n", F.struct(*df.columns).alias(name))
    both = side(before, "before").join(side(after, "after"), [*IDENTITY, "_n"], "full_outer")
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(~F.col("before.signature").eqNullSafe(F.col("after.signature")) | ~F.col("before.raw_text").eqNullSafe(F.col("after.raw_text")), "changed")
    )
    breaking = F.coalesce(F.col("before.exports"), F.lit(False)) & (F.col("after").isNull() | ~F.col("before.signature").eqNullSafe(F.col("after.signature")))
    return both.select(change.alias("change"), breaking.alias("breaking"), "before", "after").filter("change IS NOT NULL")


def exact_renames(changes: DataFrame) -> DataFrame:
    """(before, after): removed and added symbols of one kind whose texts are alike but for their own name, where only one of each is."""
    key = lambda s: F.struct(F.col(f"{s}.kind"), blank_identifier(F.trim(F.col(f"{s}.raw_text")), F.col(f"{s}.name")))

    def side(s: str, change: str) -> DataFrame:
        rows = changes.filter((F.col("change") == change) & (F.octet_length(F.trim(F.col(f"{s}.raw_text"))) >= LEAST_BODY)).select(key(s).alias("key"), s)
        return rows.groupBy("key").agg(F.first(s).alias(s), F.count("*").alias("n")).filter("n = 1").drop("n")

    return side("before", "removed").join(side("after", "added"), "key").select("before", "after")


def partial_renames(changes: DataFrame) -> DataFrame:
    """As exact_renames for texts that mention both names (a stale comment): both names are blanked on both sides. Only where few symbols remain on each side."""
    sized = lambda s, c: changes.filter((F.col("change") == c) & (F.octet_length(F.trim(F.col(f"{s}.raw_text"))) >= LEAST_BODY)).select(s)
    old, new = sized("before", "removed"), sized("after", "added")
    few = old.agg(F.count("*").alias("a")).crossJoin(new.agg(F.count("*").alias("b"))).filter(f"a <= {MOST_PARTIAL} AND b <= {MOST_PARTIAL}")
    blank = lambda s: blank_identifier(blank_identifier(F.trim(F.col(f"{s}.raw_text")), F.col("before.name")), F.col("after.name"))
    pairs = old.crossJoin(F.broadcast(few)).crossJoin(new).filter((F.col("before.kind") == F.col("after.kind")) & (blank("before") == blank("after")))
    by_old, by_new = Window.partitionBy(F.col("before.id")), Window.partitionBy(F.col("after.id"))
    return pairs.withColumns({"x": F.count("*").over(by_old), "y": F.count("*").over(by_new)}).filter("x = 1 AND y = 1").select("before", "after")


def with_renames(changes: DataFrame) -> DataFrame:
    """The changes with removed and added pairs told as 'renamed': breaking where exported and the qualified name changed; a move is not."""
    exact = exact_renames(changes)
    gone = lambda df, pairs: df.join(pairs.select(F.col("before.id").alias("_b")), F.col("before.id") == F.col("_b"), "left_anti").join(pairs.select(F.col("after.id").alias("_a")), F.col("after.id") == F.col("_a"), "left_anti")
    open_ = changes.filter("change IN ('added', 'removed')")
    rest = gone(open_, exact)
    pairs = exact.unionByName(partial_renames(rest))
    breaking = F.coalesce(F.col("before.exports"), F.lit(False)) & ~F.col("before.qualified_name").eqNullSafe(F.col("after.qualified_name"))
    renamed = pairs.select(F.lit("renamed").alias("change"), breaking.alias("breaking"), "before", "after")
    return changes.filter("change = 'changed'").unionByName(gone(open_, pairs)).unionByName(renamed)
