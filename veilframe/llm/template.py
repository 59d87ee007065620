"""A sandboxed template language, compiled to Python closures.

Text stands for itself; ``{{ x }}`` puts a value; ``{% for m in x %}``, ``{% if x %}`` with ``elif`` and ``else``, ``{% set
n = x %}`` and ``{% generation %}`` are blocks. A dash inside a tag strips white space on its side. Expressions have
strings, integers, names, ``true false none``, ``a.b``, ``a["b"]``, ``|filter``, ``~`` (join), ``+``, comparisons, ``in``,
``not``, ``and`` and ``or``. There are no calls, and a dot only looks up keys of mappings, so a template reaches nothing
but the values it is given.

parse() makes a syntax tree, fold() computes what is constant in it, compiled() turns it into closures that yield pieces
(text, whether within a generation block). A loop takes its values from any iterator, one ahead, so what is rendered
needn't fit in memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Put:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: x.strip(),
    "upper": lambda x: x.upper(),
    "lower": lambda x: x.lower(),
    "length": len,
    "escape": lambda x: x.replace("\\", "\\\\").replace("<", "\\<"),
    "line": lambda x: x.replace("\\", "\\\\").replace("<", "\\<").replace("\n", "\\n"),
}
OPS: dict[str, Callable[..., Any]] = {
    "not": lambda a: not a,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: said(a) + said(b),
}
TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>~+|.()\[\]=]))""")
STRING = {"n": "\n", "t": "\t", "r": "\r"}


class Fixed(str):
    """A piece that is the template's own text, whatever the values are."""


def said(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        at = m.end()
        if m[1]:
            out.append(("const", re.sub(r"\\(.)", lambda k: STRING.get(k[1], k[1]), m[1][1:-1], flags=re.S)))
        elif m[2]:
            out.append(("const", int(m[2])))
        else:
            out.append(("name" if m[3] else "op", m[3] or m[4]))
    return out


class _Expression:
    """Recursive descent, loosest first: or, and, not, comparison, joins, filters and keys."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None, value: str | None = None) -> Any:
        if self.at == len(self.tokens) or kind and self.tokens[self.at][0] != kind or value and self.tokens[self.at][1] != value:
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def binary(self, below: Callable[[], Any], *ops: str) -> Any:
        left = below()
        while self.peek(*ops):
            left = Op(self.take(), (left, below()))
        return left

    def expression(self) -> Any:
        return self.binary(lambda: self.binary(self.negation, "and"), "or")

    def negation(self) -> Any:
        if self.peek("not"):
            self.take()
            return Op("not", (self.negation(),))
        return self.binary(lambda: self.binary(self.postfix, "+", "~"), "==", "!=", "<", ">", "<=", ">=", "in")

    def postfix(self) -> Any:
        value = self.primary()
        while self.peek(".", "[", "|"):
            op = self.take()
            if op == "[":
                value = Item(value, self.expression())
                self.take("op", "]")
            elif op == ".":
                value = Item(value, Const(self.take("name")))
            else:
                name = self.take("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                value = Filter(value, name)
        return value

    def primary(self) -> Any:
        if self.peek("("):
            self.take()
            value = self.expression()
            self.take("op", ")")
            return value
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)
        if kind not in ("const", "name"):
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        return Const(value) if kind == "const" else Const({"true": True, "false": False}.get(value)) if value in ("true", "false", "none") else Name(value)

    def whole(self) -> Any:
        value = self.expression()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value


def _pieces(source: str) -> list[tuple[str, str]]:
    """("text" | "put" | "block", content) in order, white space stripped where a dash says so."""
    out, at, strip = [], 0, False
    for m in TAG.finditer(source):
        put = m[2] is not None
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if m[1] or m[4] else text))
        out.append(("put", m[2]) if put else ("block", m[5].strip()))
        at, strip = m.end(), bool(m[3] or m[6])
    return [*out, ("text", source[at:].lstrip() if strip else source[at:])]


def parse(source: str) -> tuple:
    pieces = _pieces(source)
    at = 0

    def body(*ends: str) -> tuple[tuple, str]:
        """Nodes up to a block that begins with one of ends, and that block."""
        nonlocal at
        out: list[Any] = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                out.append(Put(Const(content)))
                continue
            if kind == "put":
                out.append(Put(_Expression(content).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(out), content
            if word == "for":
                m = re.fullmatch(r"(\w+)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {content!r}")
                out.append(For(m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "if":
                out.append(branch(rest))
            elif word == "set":
                name, _, value = rest.partition("=")
                out.append(Set(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                out.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"no block {word!r}")
        if ends:
            raise TemplateError(f"no {ends[0]}")
        return tuple(out), ""

    def branch(test: str) -> If:
        then, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).whole(), then, (branch(end[4:]),))
        return If(_Expression(test).whole(), then, body("endif")[0] if end == "else" else ())

    return body()[0]


def fold(node: Any) -> Any:
    """The same tree with constant parts computed, branches of constant tests chosen and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for n in map(fold, node):
            for x in n if isinstance(n, tuple) else (n,):
                if out and all(isinstance(p, Put) and isinstance(p.value, Const) for p in (x, out[-1])):
                    out[-1] = Put(Const(said(out[-1].value.value) + said(x.value.value)))
                elif x != Put(Const("")):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Const(OPS[node.op](*(a.value for a in args))) if node.op in OPS and all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, Put):
        return Put(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        return fold(node.then if test.value else node.other) if isinstance(test, Const) else If(test, fold(node.then), fold(node.other))
    return node


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(env: dict) -> Any:
            x, k = of(env), key(env)
            if isinstance(x, Mapping):
                return x.get(k)
            if isinstance(x, (list, tuple, str)) and isinstance(k, int):
                return x[k] if -len(x) <= k < len(x) else None
            raise TemplateError(f"no {k!r} here")

        return item
    if isinstance(node, Filter):
        of, call = _value(node.of), FILTERS[node.name]
        return lambda env: call(of(env))
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    op = OPS[node.op]
    return (lambda env: op(args[0](env))) if len(args) == 1 else (lambda env: op(args[0](env), args[1](env)))


Piece = tuple[str, bool]
Rendered = Callable[[dict, bool], Iterator[Piece]]


def _looped(node: For) -> Rendered:
    over, body, name = _value(node.over), compiled(node.body), node.name

    def run(env: dict, masked: bool) -> Iterator[Piece]:
        values: Iterable = over(env) or ()
        ahead = iter(values)
        end = object()
        x, k = next(ahead, end), 0
        while x is not end:
            after = next(ahead, end)
            yield from body(env | {name: x, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": after is end}}, masked)
            x, k = after, k + 1

    return run


def compiled(nodes: tuple) -> Rendered:
    def one(node: Any) -> Rendered:
        if isinstance(node, Put) and isinstance(node.value, Const):
            fixed = Fixed(said(node.value.value))

            def put(env: dict, masked: bool) -> Iterator[Piece]:
                yield fixed, masked

            return put
        if isinstance(node, Put):
            value = _value(node.value)

            def put(env: dict, masked: bool) -> Iterator[Piece]:
                yield said(value(env)), masked

            return put
        if isinstance(node, Set):
            value, name = _value(node.value), node.name

            def assign(env: dict, masked: bool) -> Iterator[Piece]:
                env[name] = value(env)
                return iter(())

            return assign
        if isinstance(node, For):
            return _looped(node)
        if isinstance(node, Generation):
            body = compiled(node.body)
            return lambda env, masked: body(env, True)
        test, then, other = _value(node.test), compiled(node.then), compiled(node.other)
        return lambda env, masked: (then if test(env) else other)(env, masked)

    parts = [one(n) for n in nodes]

    def run(env: dict, masked: bool) -> Iterator[Piece]:
        for p in parts:
            yield from p(env, masked)

    return run


def template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function from values, by name, to pieces."""
    run = compiled(fold(parse(source)))
    return lambda **values: run(dict(values), False)
