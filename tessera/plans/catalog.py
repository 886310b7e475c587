"""All registered queries of the engine."""

from tessera.plans import code_catalog, graph_catalog, text_catalog  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
