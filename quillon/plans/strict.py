"""Refusals: shapes that the dialect doesn't have, for users who need the same limits."""

from __future__ import annotations

import re

from quillon.operators.query import QueryError

#: Constructs that are refused in strict mode.
REFUSED = {
    r"\b(?:CROSS|OUTER)\s+APPLY\b|\bLATERAL\b": "lateral joins",
    r"\bFULL\s+(?:OUTER\s+)?JOIN\b": "full outer joins",
    r"\bINTERSECT\b": "INTERSECT",
    r"\bEXCEPT\b": "EXCEPT",
    r"\bOVER\s*\(": "window functions",
    r"\bCOLLATE\b": "COLLATE",
    r"\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(\s*DISTINCT\b": "aggregates over DISTINCT",
    r"\b(?:ROLLUP|CUBE|GROUPING\s+SETS)\b": "grouping sets",
    r"\bAT\s+TIME\s+ZONE\b": "AT TIME ZONE",
    r"<<|>>": "shifts",
    r"->": "JSON paths",
    r"\b(?:RLIKE|REGEXP)\b": "regular expressions",
}


def check(sql: str) -> None:
    """Raises ``QueryError`` for what strict mode refuses. Quoted text is not looked at."""
    bare = re.sub(r"'(?:[^']|'')*'|`[^`]*`|\[[^\]]*\]", "''", sql)
    for pattern, what in REFUSED.items():
        if re.search(pattern, bare, re.I):
            raise QueryError(f"the dialect has no {what}")
