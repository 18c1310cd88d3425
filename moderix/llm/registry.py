"""The queries op1 to op10 and the SQL of those that SQL can express."""

from __future__ import annotations

from moderix.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
