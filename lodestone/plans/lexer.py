"""SQL text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError


@dataclass(frozen=True)
class Token:
    kind: str  # word number string symbol end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_PATTERN = re.compile(
    r"""\s*(?:
      (?P<word>[^\W\d]\w*)
    | (?P<number>-?\d+(?:\.\d+)?)
    | (?P<string>'(?:[^']|'')*')
    | (?P<symbol><>|<=|>=|!=|[=<>,.()*;])
    )""",
    re.VERBOSE,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    end = len(sql.rstrip())
    while at < end:
        found = _PATTERN.match(sql, at)
        if not found:
            rest = sql[at:].lstrip()
            raise ParseError("unclosed string" if rest.startswith("'") else f"unexpected character {rest[0]!r} at {sql.index(rest[0], at)}")
        kind = found.lastgroup or ""
        text = found[kind]
        if kind == "number" and re.match(r"\w", sql[found.end() : found.end() + 1]):
            raise ParseError(f"a number can't be followed by {sql[found.end()]!r}")
        out.append(Token(kind, text[1:-1].replace("''", "'") if kind == "string" else text, found.start(kind)))
        at = found.end()
    return [*out, Token("end", "", len(sql))]
