"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% for x in expression %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   marks text a model is to produce

Expressions: strings, whole numbers, true, false, none; names; .field of a
mapping; == != in, and, or, not; + of strings; value | filter; parentheses.  There
are no calls, no subscripts and no Python attributes, so a template can reach
nothing but the values it is given.  Text is parsed into a syntax tree, parts that
depend on no name are computed once, and what is left becomes closures.  Loops
draw their items one by one, so a loop over a stream holds one item and the next.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

Emit = Callable[[str, bool], None]

_PIECES = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKENS = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[().|+]))")
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Apply:
    """A named operation on values: an operator or a filter."""

    op: str
    args: tuple


@dataclass
class Output:
    value: object


@dataclass
class If:
    arms: list = field(default_factory=list)  # (condition or None, body)


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class Generation:
    body: list


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent, loosest first: or, and, not, comparison, +, filters, fields."""

    def __init__(self, source: str, filters: Mapping[str, Callable]) -> None:
        self.tokens, self.at, self.filters = _tokens(source), 0, filters

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("op", "name") and value in values

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        out = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.peek("or"):
            self.take()
            out = Apply("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.peek("and"):
            self.take()
            out = Apply("and", (out, self.negated()))
        return out

    def negated(self):
        if self.peek("not"):
            self.take()
            return Apply("not", (self.negated(),))
        return self.compared()

    def compared(self):
        out = self.added()
        while self.peek("==", "!=", "in"):
            out = Apply(self.take()[1], (out, self.added()))
        return out

    def added(self):
        out = self.filtered()
        while self.peek("+"):
            self.take()
            out = Apply("+", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.atom()
        while self.peek("|", "."):
            bar = self.take()[1] == "|"
            kind, name = self.take()
            if kind != "name" or bar and name not in self.filters:
                raise TemplateError(f"no such {'filter' if bar else 'field'}: {name!r}")
            out = Apply("|" + name, (out,)) if bar else Field(out, name)
        return out

    def atom(self):
        kind, value = self.take()
        if kind == "text":
            return Const(value[1:-1])
        if kind == "int":
            return Const(int(value))
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Const(_CONSTANTS[value]) if value in _CONSTANTS else Name(value)
        if value == "(":
            out = self.either()
            if self.take()[1] != ")":
                raise TemplateError("missing )")
            return out
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: Mapping[str, Callable]) -> list:
    """The syntax tree: a list of nodes."""
    root: list = []
    open_: list[tuple[str, object, list]] = [("", None, root)]
    expression = lambda s: _Expression(s, filters).whole()
    at = 0
    for m in [*_PIECES.finditer(source), None]:
        if literal := source[at : m.start() if m else len(source)]:
            open_[-1][2].append(Output(Const(literal)))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            open_[-1][2].append(Output(expression(m[1])))
            continue
        word, _, rest = m[2].strip().partition(" ")
        kind, node, body = open_[-1]
        if word == "for":
            name, _, over = rest.strip().partition(" in ")
            if not name.isidentifier():
                raise TemplateError(f"not a name: {name!r}")
            node = For(name, expression(over), [])
            body.append(node)
            open_.append(("for", node, node.body))
        elif word == "generation":
            node = Generation([])
            body.append(node)
            open_.append(("generation", node, node.body))
        elif word == "if":
            node = If([(expression(rest), [])])
            body.append(node)
            open_.append(("if", node, node.arms[-1][1]))
        elif word in ("elif", "else") and kind == "if" and node.arms[-1][0] is not None:
            node.arms.append((expression(rest) if word == "elif" else None, []))
            open_[-1] = (kind, node, node.arms[-1][1])
        elif word == "end" + kind and kind:
            open_.pop()
        else:
            raise TemplateError(f"unexpected tag {word!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} isn't closed")
    return root


def _operation(op: str, filters: Mapping[str, Callable]) -> Callable:
    if op.startswith("|"):
        return filters[op[1:]]
    return {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}[op]


def fold(node, filters: Mapping[str, Callable]):
    """The same tree with all parts computed that depend on no name, and neighbouring literals joined."""
    if isinstance(node, Apply):
        args = tuple(fold(a, filters) for a in node.args)
        return Const(_operation(node.op, filters)(*[a.value for a in args])) if all(isinstance(a, Const) for a in args) else Apply(node.op, args)
    if isinstance(node, Field):
        return Field(fold(node.of, filters), node.name)
    if isinstance(node, Output):
        return Output(fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        arms = []
        for test, body in node.arms:
            test = None if test is None else fold(test, filters)
            if isinstance(test, Const) and not test.value:
                continue
            if isinstance(test, Const):
                test = None
            arms.append((test, fold(body, filters)))
            if test is None:
                break
        return If(arms)
    if isinstance(node, list):
        out: list = []
        for x in (fold(n, filters) for n in node):
            inner = x.arms[0][1] if isinstance(x, If) and x.arms and x.arms[0][0] is None else [] if isinstance(x, If) and not x.arms else [x]
            for y in inner:
                if out and all(isinstance(z, Output) and isinstance(z.value, Const) for z in (out[-1], y)):
                    out[-1] = Output(Const(_shown(out[-1].value.value) + _shown(y.value.value)))
                else:
                    out.append(y)
        return out
    return node


def _shown(value) -> str:
    return "" if value is None else str(value)


def _value(node, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Field):
        of, name = _value(node.of, filters), node.name

        def get(env: dict) -> object:
            held = of(env)
            if not isinstance(held, Mapping):
                raise TemplateError(f"no fields: {name!r} of {type(held).__name__}")
            return held.get(name)

        return get
    args = [_value(a, filters) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    run = _operation(node.op, filters)
    if len(args) == 1:
        return lambda env: run(args[0](env))
    return lambda env: run(args[0](env), args[1](env))


def _statement(node, filters: Mapping[str, Callable], made: bool) -> Callable[[dict, Emit], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _shown(node.value.value)
            return lambda env, emit: emit(text, made)
        value = _value(node.value, filters)
        return lambda env, emit: emit(_shown(value(env)), made)
    if isinstance(node, Generation):
        return _block(node.body, filters, True)
    if isinstance(node, If):
        arms = [(None if test is None else _value(test, filters), _block(body, filters, made)) for test, body in node.arms]

        def choose(env: dict, emit: Emit) -> None:
            for test, body in arms:
                if test is None or test(env):
                    return body(env, emit)
            return None

        return choose
    over, body, name = _value(node.over, filters), _block(node.body, filters, made), node.name

    def loop(env: dict, emit: Emit) -> None:
        items = iter(over(env) or ())
        end = object()
        item, i = next(items, end), 0
        while item is not end:
            after = next(items, end)
            body(env | {name: item, "loop": {"index0": i, "first": i == 0, "last": after is end}}, emit)
            item, i = after, i + 1

    return loop


def _block(nodes: list, filters: Mapping[str, Callable], made: bool) -> Callable[[dict, Emit], None]:
    parts = [_statement(n, filters, made) for n in nodes]

    def run(env: dict, emit: Emit) -> None:
        for part in parts:
            part(env, emit)

    return run


#: Filters that every template has.
FILTERS: dict[str, Callable] = {"trim": lambda s: _shown(s).strip(), "lower": lambda s: _shown(s).lower(), "upper": lambda s: _shown(s).upper()}


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict, Emit], None]:
    """render(names, emit); emit gets each piece of text and whether it is marked as generation."""
    known = FILTERS | dict(filters or {})
    return _block(fold(parse(source, known), known), known, False)


def render(template: Callable[[dict, Emit], None], messages: Iterable[Mapping], **names) -> tuple[str, list[tuple[int, int]]]:
    """The whole output and the marked spans in it, in code points."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def emit(text: str, made: bool) -> None:
        nonlocal at
        out.append(text)
        if made and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        at += len(text)

    template({"messages": messages, **names}, emit)
    return "".join(out), spans
