"""What the driver registers of this part: the operators' queries and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from docnest.llm import oracle, queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE = dict(oracle.ORACLE)
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
