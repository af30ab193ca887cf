"""All queries of the library outside the llm subpackage, with their SQL."""

from __future__ import annotations

from quillspark.plans import catalogue, evidence, pipeline, problems, reference, relations, texts

_PARTS = [problems, reference, pipeline, texts, relations, catalogue, evidence]

QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL = {k: s for m in _PARTS for k, s in m.SQL.items()}
