"""What the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.runtime import fresh, materialize, shared_dir, shared_path, ship

__all__ = ["fresh", "map_arrow", "materialize", "shared_dir", "shared_path"]


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow, with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
