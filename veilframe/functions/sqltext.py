"""Expressions as SQL text, for SQL functions whose bodies are the operators' own expressions and so stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column

STRING = re.compile(r"'(?:[^'\\]|\\.)*'", re.S)
#: Spark writes operators as calls; as names in quotes the parser takes them for the functions that they are.
OPERATOR = re.compile(r"(?<![\w`<>=!+*/%&|^.-])(<=>|<=|>=|!=|=|<|>|\+|-|\*|/|%|and|or|not|!)\(")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose parenthesis opens at ``at``, and where it ends."""
    parts, depth, last = [], 0, at + 1
    for k in range(at, len(text)):
        c = text[k]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if not depth or (depth == 1 and c == ","):
            parts.append(text[last:k].strip())
            last = k + 1
        if not depth:
            return parts, k + 1
    raise ValueError("a parenthesis doesn't close")


def _named(text: str) -> str:
    """Zipped arrays with their names, which SQL has no words for within a call: the rows get them afterwards."""
    head, n = "arrays_zip(", 0
    at = text.rfind(head)
    while at >= 0:
        parts, end = _arguments(text, at + len(head) - 1)
        pairs = [p.rsplit(" AS ", 1) for p in parts]
        fields = ", ".join(f"'{name}', z_{n}['{i}']" for i, (_, name) in enumerate(pairs))
        text = f"{text[:at]}transform(zipped({', '.join(p for p, _ in pairs)}), z_{n} -> named_struct({fields})){text[end:]}"
        at, n = text.rfind(head), n + 1
    return text.replace("zipped(", head)


def to_sql(column: Column) -> str:
    """The SQL text of a column of a classic session; literals with a point are doubles."""
    strings: list[str] = []

    def hide(m: re.Match[str]) -> str:
        strings.append(m[0])
        return f"\x00{len(strings) - 1}\x00"

    text = OPERATOR.sub(r"`\1`(", STRING.sub(hide, column._jc.node().sql()))
    text = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", text)
    return re.sub("\x00(\\d+)\x00", lambda m: strings[int(m[1])], _named(text))
