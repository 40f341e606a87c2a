"""SQL text for expressions with many parts.

A tree or a wide histogram has hundreds of sub-expressions. Handing Spark one text to parse
is far cheaper than building such an expression node by node from Python; the plan is the
same.
"""

from __future__ import annotations

import math
from typing import Optional, Sequence


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def names(columns: Sequence[str]) -> list[str]:
    return [name(c) for c in columns]


def literal(value, kind: Optional[str] = None) -> str:
    """A literal; ``kind`` adds a cast, needed for nulls."""
    if value is None:
        text = "NULL"
    elif isinstance(value, bool):
        text = "true" if value else "false"
    elif isinstance(value, int):
        text = str(value)
    elif isinstance(value, float):
        text = f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    else:
        text = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({text} AS {kind})" if kind and (value is None or kind == "bigint") else text


def case(cases: Sequence[tuple[str, str]], otherwise: Optional[str] = None) -> str:
    if not cases:
        return otherwise or "NULL"
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in cases)
    return f"CASE {whens}{' ELSE ' + otherwise if otherwise is not None else ''} END"


def literal_array(values: Sequence, kind: str) -> str:
    """Numbers or flags as an array literal; there must be at least one, and no null. It is one
    string that is split and cast, which Spark folds while planning: its parser sees a single token."""
    words = (str(v).lower() if kind == "boolean" else repr(v) for v in values)
    return f"CAST(split('{','.join(words)}', ',') AS array<{kind}>)"
