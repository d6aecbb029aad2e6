"""A small sandboxed template language, compiled to Python closures.

Syntax: text, {{ expression }}, {# note #}, {% set name = e %}, {% if e %} {% elif e %} {% else %} {% endif %},
{% for name in e %} {% endfor %} (with loop.index, loop.index0, loop.first), {% generation %} {% endgeneration %}. A minus
inside a brace trims white space on that side. Expressions: strings, integers, true, false, none, names, a.b, a['b'],
a[0], not, and, or, in, == != < <= > >=, + - * % ~ (joins texts), c if e else d, filters after a bar: trim, upper, lower,
length, default(e), string, escape (of control strings), json.

A template is parsed to a syntax tree, constants are folded (operators on constants, branches that are never taken,
neighbouring texts), and every node becomes a closure. Attributes are looked up in mappings only, there are no calls but
filters and no names but those handed in, so a template cannot reach Python objects; repetition by * and loops over
numbers do not exist, so output is bounded by the input. Closures are generators of (text, generated) pieces: a loop takes
its messages one after another from an iterator, so a conversation need not be in memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

_LEX = re.compile(r"\{#-?.*?-?#\}|\{%-?.*?-?%\}|\{\{-?.*?-?\}\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>()\[\].,|=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


# Syntax tree: expressions.


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object
    args: tuple


# Statements.


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            kind = "int" if m[1] else "str" if m[2] else "name" if m[3] else "op"
            self.tokens.append((kind, m[1] or m[2] or m[3] or m[4]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> object:
        value = self.expression()
        self.end()
        return value

    def expression(self) -> object:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Op("if", (test, value, self.expression()))
        return value

    def _left(self, below: Callable[[], object], *ops: str) -> object:
        value = below()
        while op := self.take(*ops):
            value = Op(op, (value, below()))
        return value

    def either(self) -> object:
        return self._left(self.both, "or")

    def both(self) -> object:
        return self._left(self.negated, "and")

    def negated(self) -> object:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> object:
        value = self.summed()
        if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            return Op(op, (value, self.summed()))
        if self.peek("not"):
            self.need("not")
            self.need("in")
            return Op("not", (Op("in", (value, self.summed())),))
        return value

    def summed(self) -> object:
        return self._left(self.multiplied, "+", "-", "~")

    def multiplied(self) -> object:
        return self._left(self.filtered, "*", "%")

    def filtered(self) -> object:
        value = self.reached()
        while self.take("|"):
            name, args = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.peek(")"):
                    args.append(self.expression())
                    if not self.take(","):
                        break
                self.need(")")
            value = Filter(name, value, tuple(args))
        return value

    def reached(self) -> object:
        value = self.atom()
        while True:
            if self.take("."):
                value = Get(value, Const(self.name()))
            elif self.take("["):
                value = Get(value, self.expression())
                self.need("]")
            else:
                return value

    def atom(self) -> object:
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.take("-"):
            return Op("-", (Const(0), self.atom()))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return Const(constants[text.lower()]) if text.lower() in constants else Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The statements of a template."""
    stack: list[tuple[str, object, list]] = [("", None, [])]
    at, trim = 0, False
    for m in [*_LEX.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if trim:
            text = text.lstrip()
        if m and m[0][2] == "-":
            text = text.rstrip()
        if text:
            stack[-1][2].append(Out(Const(text)))
        if not m:
            break
        at, trim = m.end(), m[0][-3] == "-"
        inner = m[0][2:-2].strip("-").strip()
        if m[0][1] == "#":
            continue
        if m[0][1] == "{":
            stack[-1][2].append(Out(_Expression(inner).whole()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "if":
            stack.append(("if", [(_Expression(rest).whole())], []))
        elif word in ("elif", "else"):
            kind, tests, body = stack.pop()
            if kind != "if":
                raise TemplateError(f"{word} without if")
            tests.append(tuple(body))
            if word == "elif":
                tests.append(_Expression(rest).whole())
            stack.append(("if" if word == "elif" else "else", tests, []))
        elif word == "endif":
            kind, tests, body = stack.pop()
            if kind not in ("if", "else"):
                raise TemplateError("endif without if")
            tests.append(tuple(body))
            other: tuple = tests.pop() if kind == "else" else ()
            while tests:
                then, test = tests.pop(), tests.pop()
                other = (If(test, then, other),)
            stack[-1][2].extend(other)
        elif word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            stack.append(("for", (name, e.whole()), []))
        elif word == "endfor":
            kind, head, body = stack.pop()
            if kind != "for":
                raise TemplateError("endfor without for")
            stack[-1][2].append(For(*head, tuple(body)))
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word == "endgeneration":
            kind, _, body = stack.pop()
            if kind != "generation":
                raise TemplateError("endgeneration without generation")
            stack[-1][2].append(Generation(tuple(body)))
        elif word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            stack[-1][2].append(Set(name, e.whole()))
        else:
            raise TemplateError(f"no statement {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} does not end")
    return tuple(stack[0][2])


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def _get(of: object, key: object) -> object:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: b is not None and a in b,
    "not": lambda a: not a,
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "%": lambda a, b: int(a) % int(b),
    "*": lambda a, b: int(a) * int(b),
}


class Controls:
    """Escapes control strings reversibly: a backslash goes behind the first character of each, one more if some are there."""

    def __init__(self, strings: Iterable[str]) -> None:
        strings = sorted({s for s in strings if len(s) > 1}, key=lambda s: (-len(s), s))
        for a in strings:
            for b in strings:
                if a != b and any(b.startswith(a[i : i + len(b)]) for i in range(1, len(a) - 1)):
                    raise TemplateError(f"control strings {a!r} and {b!r} overlap")
        self.strings = strings
        one = "|".join(rf"(?<={re.escape(s[0])})(\\*){re.escape(s[1:])}" for s in strings)
        self.find = re.compile(f"(?:{one})") if strings else None
        undo = "|".join(rf"(?<={re.escape(s[0])})\\(?=\\*{re.escape(s[1:])})" for s in strings)
        self.undo = re.compile(undo) if strings else None

    def escaped(self, text: str) -> str:
        return self.find.sub(lambda m: "\\" + m[0], text) if self.find else text

    def unescaped(self, text: str) -> str:
        return self.undo.sub("", text) if self.undo else text


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if v is not None else 0,
    "default": lambda v, d="": d if v is None else v,
    "string": _text,
    "json": lambda v: json.dumps(v, ensure_ascii=False),
    "escape": None,  # bound to the template's control strings
}


def folded(node: object) -> object:
    """The tree with constants folded."""
    if isinstance(node, tuple):
        out: list = []
        for n in map(folded, node):
            for one in n if isinstance(n, tuple) else (n,):
                if isinstance(one, Out) and isinstance(one.value, Const):
                    one = Out(Const(_text(one.value.value)))
                    if not one.value.value:
                        continue
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        out[-1] = Out(Const(out[-1].value.value + one.value.value))
                        continue
                out.append(one)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(folded, node.args))
        if node.op == "if" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in _OPERATORS and all(isinstance(a, Const) for a in args):
            return Const(_OPERATORS[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Get):
        of, key = folded(node.of), folded(node.key)
        return Const(_get(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Get(of, key)
    if isinstance(node, Filter):
        of, args = folded(node.of), tuple(map(folded, node.args))
        if node.name != "escape" and all(isinstance(a, Const) for a in (of, *args)):
            return Const(FILTERS[node.name](of.value, *(a.value for a in args)))
        return Filter(node.name, of, args)
    if isinstance(node, Out):
        return Out(folded(node.value))
    if isinstance(node, Set):
        return Set(node.name, folded(node.value))
    if isinstance(node, If):
        test = folded(node.test)
        if isinstance(test, Const):
            return folded(node.then if test.value else node.other)
        return If(test, folded(node.then), folded(node.other))
    if isinstance(node, For):
        return For(node.name, folded(node.over), folded(node.body))
    if isinstance(node, Generation):
        return Generation(folded(node.body))
    return node


Piece = tuple[str, bool]


class Template:
    """A compiled template; render() yields (text, whether it is generated) in order."""

    def __init__(self, source: str, controls: Iterable[str] = ()) -> None:
        self.controls = Controls(controls)
        self.tree = folded(parse(source))
        self._run = self._body(self.tree)

    def render(self, **names: object) -> Iterator[Piece]:
        return self._run(dict(names), False)

    def _value(self, node: object) -> Callable[[dict], object]:
        if isinstance(node, Const):
            value = node.value
            return lambda names: value
        if isinstance(node, Name):
            name = node.name
            return lambda names: names.get(name)
        if isinstance(node, Get):
            of, key = self._value(node.of), self._value(node.key)
            return lambda names: _get(of(names), key(names))
        if isinstance(node, Filter):
            of, args = self._value(node.of), [self._value(a) for a in node.args]
            if node.name == "escape":
                escaped = self.controls.escaped
                return lambda names: escaped(_text(of(names)))
            run = FILTERS[node.name]
            return lambda names: run(of(names), *(a(names) for a in args))
        a, *rest = [self._value(x) for x in node.args]
        if node.op == "if":
            then, other = rest
            return lambda names: then(names) if a(names) else other(names)
        if node.op == "and":
            return lambda names: a(names) and rest[0](names)
        if node.op == "or":
            return lambda names: a(names) or rest[0](names)
        run = _OPERATORS[node.op]
        if not rest:
            return lambda names: run(a(names))
        b = rest[0]
        return lambda names: run(a(names), b(names))

    def _body(self, nodes: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
        parts = [self._statement(n) for n in nodes]

        def run(names: dict, generated: bool) -> Iterator[Piece]:
            for part in parts:
                yield from part(names, generated)

        return run

    def _statement(self, node: object) -> Callable[[dict, bool], Iterator[Piece]]:
        if isinstance(node, Out):
            value = self._value(node.value)

            def out(names: dict, generated: bool) -> Iterator[Piece]:
                if text := _text(value(names)):
                    yield text, generated

            return out
        if isinstance(node, Set):
            name, value = node.name, self._value(node.value)

            def put(names: dict, generated: bool) -> Iterator[Piece]:
                names[name] = value(names)
                yield from ()

            return put
        if isinstance(node, If):
            test, then, other = self._value(node.test), self._body(node.then), self._body(node.other)
            return lambda names, generated: (then if test(names) else other)(names, generated)
        if isinstance(node, Generation):
            body = self._body(node.body)
            return lambda names, generated: body(names, True)
        name, over, body = node.name, self._value(node.over), self._body(node.body)

        def loop(names: dict, generated: bool) -> Iterator[Piece]:
            items = over(names)
            if isinstance(items, (str, int)) or items is None:
                return
            for i, item in enumerate(items):
                yield from body(names | {name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0}}, generated)

        return loop
