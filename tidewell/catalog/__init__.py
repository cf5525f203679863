"""Queries of the reference's operators over the synthetic tables, each beside its SQL.

Modules register theirs with ``@query(sql)``; ``QUERIES`` and ``ORACLE_SQL`` are
what the driver's entry file exposes.
"""

from tidewell.catalog import aggregates, apps, bodies, crawls, details, flows, joins, labels, names, notices, records, scalars, selections
from tidewell.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "apps", "bodies", "crawls", "details", "flows", "joins", "labels", "names", "notices", "records", "scalars", "selections"]
