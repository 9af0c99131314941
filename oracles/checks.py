"""SQL for each registered query; columns carry the same names on both sides."""

from __future__ import annotations

from oracles import answers, documents, graph, retrieval, store
from oracles.ctes import statement


def statements() -> dict[str, str]:
    merged: dict[str, str] = {}
    for part in (documents, retrieval, graph, answers, store):
        merged.update(part.SQL)
    return {name: statement(sql) for name, sql in merged.items()}
