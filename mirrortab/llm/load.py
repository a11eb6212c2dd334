"""All queries of this subpackage, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from mirrortab.llm import common


def load_all() -> tuple[dict, dict]:
    from mirrortab.llm import (  # noqa: F401
        audit, bpe, decontaminate, html, licenses, periods, pii, quality, repeats, sharding, simhash, topk, toxicity,
    )

    queries, sql = {**common.QUERIES, "pipeline": corpus_pipeline.run}, dict(common.SQL)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, sql
