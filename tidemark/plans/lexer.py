"""Tokens of the dialect.

There are no comments and no quoted identifiers.  Single-quoted strings double the quote to hold one; double-quoted
strings have no escape.  Semicolons are skipped wherever they stand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A statement that can't be parsed, or is refused."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, number, string, op, end
    text: str
    start: int
    end: int

    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


_TOKEN = re.compile(
    r"""(?P<skip>[\s;]+)
      | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      | (?P<name>[A-Za-z_]\w*)
      | '(?P<single>(?:[^']|'')*)'
      | "(?P<double>[^"]*)"
      | (?P<op>=\?=|=!=|==|!=|<>|<=|>=|=~|!~|&&|\|\||[-+*/%&|^~!<>=?:(),.{}\[\]])""",
    re.X | re.A,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            if text[at] in "'\"":
                raise QueryError("unterminated string literal")
            raise QueryError(f"unexpected character {text[at]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind == "skip":
            continue
        value = m[kind]
        if kind == "single":
            kind, value = "string", value.replace("''", "'")
        elif kind == "double":
            kind = "string"
        out.append(Token(kind, value, m.start(), at))
    out.append(Token("end", "", at, at))
    return out
