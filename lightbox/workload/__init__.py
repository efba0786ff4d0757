"""Every registered query, grouped like the operators."""

from lightbox.workload import registry
from lightbox.workload import (  # noqa: F401  (registers queries)
    catalog, changes, export, files, scalars, similarity, streams, tagging,
)

QUERIES = registry.QUERIES
CHECKS = registry.CHECKS
