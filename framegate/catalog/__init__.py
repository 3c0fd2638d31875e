"""All queries of the core, with their SQL: name -> (spark, folder) -> DataFrame, and name -> SQL."""

from framegate.catalog import claims, evaluation, gate, selection

QUERIES = {**selection.QUERIES, **evaluation.QUERIES, **gate.QUERIES, **claims.QUERIES}
SQL = {**selection.SQL, **evaluation.SQL, **gate.SQL, **claims.SQL}
