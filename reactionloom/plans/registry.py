"""All core queries and their SQL."""

from __future__ import annotations

from reactionloom.plans import drawing, evaluation, identity, integrity, naming, network, output, pieces

MODULES = (network, identity, naming, evaluation, drawing, pieces, output, integrity)
FLAGSHIP = "main_pair"

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
