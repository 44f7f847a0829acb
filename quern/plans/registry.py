"""All queries of the library by name, and the SQL that checks them."""

from __future__ import annotations

from . import delivery, evidence, packages, phrases, published, records, reviews, texts

_ALL = evidence.QUERIES | texts.QUERIES | records.QUERIES | reviews.QUERIES | delivery.QUERIES | phrases.QUERIES | packages.QUERIES | published.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
