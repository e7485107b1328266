"""All queries of the core, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from quirewright.plans import metadata, metadata_sql, problems

FLAGSHIP = "author_coverage_by_source"
QUERIES = {**metadata.QUERIES, **problems.QUERIES}
ORACLE = {**metadata_sql.ORACLE, **problems.ORACLE}
