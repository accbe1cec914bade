"""The named queries of the engine and their SQL twins."""

from __future__ import annotations

from .plans import evaluation, files, lexicon, prediction, streams, study, usage

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _plan in (lexicon, prediction, study, evaluation, usage, files, streams):
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
