"""Every query of the library with its oracle SQL."""

from passagemill.plans import formats, formats_sql, oracles, queries, rules, rules_sql

QUERIES = queries.QUERIES | formats.QUERIES | rules.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | formats_sql.ORACLE_SQL | rules_sql.ORACLE_SQL
