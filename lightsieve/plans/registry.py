"""The registered queries and their SQL for an independent engine."""

from lightsieve.plans import graphs, operations, oracle
from lightsieve.plans.queries import QUERIES

ORACLE_SQL = oracle.ORACLE_SQL | graphs.ORACLE_SQL | operations.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
