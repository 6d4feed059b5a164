"""All queries of the statistical engine and their DuckDB equivalents."""

from . import audited, cohorts, extras, jobs, matrix, solved

QUERIES = {**matrix.QUERIES, **cohorts.QUERIES, **extras.QUERIES, **jobs.QUERIES}
ORACLE_SQL = {**matrix.ORACLE_SQL, **cohorts.ORACLE_SQL, **extras.ORACLE_SQL, **jobs.ORACLE_SQL, **solved.ORACLE_SQL, **audited.ORACLE_SQL}
