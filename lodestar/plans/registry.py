"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import audits, candidates, evaluation, judgments, retrieval, studies

MODULES = (retrieval, candidates, judgments, evaluation, studies, audits)
QUERIES: dict[str, Callable] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE.items()}
