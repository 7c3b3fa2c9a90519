"""All registered queries with their DuckDB counterparts."""

from tideglass.plans import answers, catalog, channels, clusters, evaluation, filters, graph, ingest, knowledge, lexical, matching, memory, relational, retrieval, splitters, streams, text, versions, workbooks  # noqa: F401  they register their queries
from tideglass.plans._base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "model_metrics"
