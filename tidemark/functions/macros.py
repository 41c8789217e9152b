"""Time macros of dashboards, replaced in the text of a statement before it is parsed."""

from __future__ import annotations

import re


def expand(text: str, start: int, end: int) -> str:
    """Put a dashboard's time range (seconds since the epoch) into a statement."""
    text = re.sub(r"\$__timeFilter\(\s*(\w+)\s*\)", lambda m: f"({m[1]} >= {start} && {m[1]} <= {end})", text)
    text = re.sub(r"\$__(?:timeFrom|unixEpochFrom)\(\s*\)", str(start), text)
    return re.sub(r"\$__(?:timeTo|unixEpochTo)\(\s*\)", str(end), text)


def build_select(table: str, columns: list[str] | None = None, filters: list[tuple[str, str, object]] | None = None, aggregates: list[tuple[str, str]] | None = None, group: list[str] | None = None, order: str | None = None, limit: int = 0) -> str:
    """A statement from a query builder's choices."""
    from ..engine import render

    shown = list(group or []) + list(columns or []) + [f"{f}({c})" for f, c in aggregates or []]
    out = f"SELECT {', '.join(shown) or '*'} FROM {table}"
    if filters:
        out += " WHERE " + " AND ".join(f"{c} {op} {render(v)}" for c, op, v in filters)
    if group:
        out += f" GROUP BY {', '.join(group)}"
    return out + (f" ORDER BY {order}" if order else "") + (f" LIMIT {limit}" if limit else "")
