"""Tokens of source text."""

from __future__ import annotations

import re

_WORD = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|&&|\|\||[=!<>+\-*/%&|^]=|\+\+|--|\S', re.S)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def lex(text: str) -> list[tuple[str, int, int]]:
    """Tokens with offsets; comments left out."""
    return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text) if not m.group().startswith(("//", "/*"))]
