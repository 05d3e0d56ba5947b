"""All queries of the subpackage and the pipeline over them, with their SQL."""
from __future__ import annotations

from corpus_pipeline import ORACLE_SQL, run
from tapeloom.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": run}
ORACLES = {**queries.ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
