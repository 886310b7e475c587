"""Joins of rows with whole groups: pairs are made where they are used and are never shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import fresh

#: About so many members are packed in an array.
PACK = 512
#: A group is sent to so many places, over which the rows that ask for it are dealt.
SPREAD = 8


def expand(rows: DataFrame, groups: DataFrame, key: list[str], member: str) -> DataFrame:
    """(rows' columns, member): the inner join of rows and groups (key, member) on key.

    What is shuffled are the rows and the groups' members, packed in arrays; a pair exists only in the task that hands it on. No
    partitions are put together, since their bytes do not tell of the pairs in them.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    size, pack, place, packed = fresh(rows.select("*", F.lit(0).alias(member)), "group_size", "group_pack", "group_place", "group_members")
    kept = groups.select(*key, member).dropna(subset=key)
    sizes = kept.groupBy(*key).agg(F.count("*").alias(size))
    part = F.pmod(F.xxhash64(member), F.greatest(F.lit(1), F.expr(f"`{size}` div {PACK}")))
    arrays = kept.join(sizes, key).groupBy(*key, part.alias(pack)).agg(F.collect_list(member).alias(packed))
    arrays = arrays.withColumn(place, F.explode(F.array(*(F.lit(i) for i in range(SPREAD))))).drop(pack)
    dealt = rows.dropna(subset=key).withColumn(place, F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int"))
    at = [*key, place]
    return dealt.repartition(tasks, *at).join(arrays.repartition(tasks, *at), at).select(*rows.columns, F.explode(packed).alias(member))
