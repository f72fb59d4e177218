"""All queries outside the optional subpackage."""

from __future__ import annotations

from sedgeline.plans import accounts, built, collection, documents, headers, maintenance, nested, relational, scalar, streams, threads

FLAGSHIP = "list_articles"
MODULES = (relational, maintenance, scalar, documents, collection, streams, accounts, built, nested, headers, threads)  # importing a module registers its queries
QUERIES = relational.QUERIES
ORACLE_SQL = relational.ORACLE_SQL
