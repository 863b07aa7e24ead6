from glossweave.workload import (  # noqa: F401
    catalog_queries,
    paragraph_queries,
    quality_queries,
    text_queries,
)
from glossweave.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
