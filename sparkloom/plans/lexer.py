"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import LoomError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<number>(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<string>'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")*")
      |(?P<word>[^\W\d]\w*)
      |(?P<op>!~~\*|!~~|~~~|~~\*|~~|!~|->>|->|\*\*|//|::|<=|>=|<>|!=|==|\|\||<<|>>|\^@|[-+*/%^&|~!<>=(),.;?\[\]:@{}])
    """,
    re.X | re.S,
)


@dataclass
class Token:
    kind: str  # number, string, quoted, word, op, end
    text: str  # words keep their case; strings and quoted names are unescaped
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise LoomError("SyntaxError", f"unexpected {sql[at]!r} at {at}")
        kind, text = m.lastgroup, m.group()
        at = m.end()
        if kind == "space":
            continue
        if kind == "string":
            text = text[1:-1].replace("''", "'")
        elif kind == "quoted":
            text = text[1:-1].replace('""', '"')
        out.append(Token(kind, text, m.start()))
    out.append(Token("end", "", len(sql)))
    return out
