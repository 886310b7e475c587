"""Which edges a traversal may follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TraversalPolicy:
    """A least confidence and reasons that are never trusted. An edge without a reason is not excluded by reason."""

    name: str
    min_confidence: float = 0.0
    excluded_reasons: tuple[str, ...] = ()

    def allows(self, confidence: str = "confidence", reason: str = "reason") -> Column:
        ok = F.col(confidence) >= self.min_confidence
        return ok & ~F.coalesce(F.col(reason), F.lit("")).isin(*self.excluded_reasons) if self.excluded_reasons else ok

    def skipped(self, edges: DataFrame) -> DataFrame:
        """(reason, skipped): how many of edges the policy turns away, by reason; below the floor counts as low-confidence unless the reason is excluded."""
        why = F.when(F.coalesce(F.col("reason"), F.lit("")).isin(*(self.excluded_reasons or ("\0",))), F.col("reason")).otherwise("low-confidence")
        return edges.filter(~self.allows()).groupBy(why.alias("reason")).agg(F.count("*").alias("skipped"))


DIAGNOSTIC = TraversalPolicy("diagnostic")
TESTS = TraversalPolicy("tests", 0.7, ("regex-fallback",))
IMPACT = TraversalPolicy("impact", 0.6, ("regex-fallback",))
CERTIFICATION = TraversalPolicy("certification", 0.9, ("dispatch", "regex-fallback", "inheritance", "constructor"))
