"""A small sandboxed template language for chats, compiled to Python closures.

Text, ``{{ expression }}``, ``{% for m in messages %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set name = expression %}`` and ``{% generation %}`` around what a model is to learn. Expressions
have strings, whole numbers, ``true false none``, names, fields of a message (``m.role``, ``m['text']``)
and of ``loop`` (``first last index index0 length``), ``== != < > <= >= in not and or + ~`` and filters.
There are no calls, no attributes of Python objects and no way to reach anything but these, so a
template from anywhere may be run. All names are resolved when it is compiled.

The loop over ``messages`` stands at the top, once. A template is thus a head, a body that is rendered
per message, and a tail, so a conversation of any length is rendered message by message.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

FIELDS = ("role", "text")
LOOP = ("first", "last", "index", "index0", "length")
_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKENS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~|.()\[\]<>,=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(),
    "capitalize": lambda x: str(x).capitalize(), "length": lambda x: len(str(x)), "string": str,
}


class TemplateError(ValueError):
    """A template that the language does not allow."""


class Node(NamedTuple):
    """``kind`` and its operands; ``const`` nodes have their value as the only operand."""

    kind: str
    args: tuple


def const(value: Any) -> Node:
    return Node("const", (value,))


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: str(a) in str(b),
    "~": lambda a, b: f"{a}{b}",
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}",
}


class _Expressions:
    """Parses one expression; every operation on constants is done here, once."""

    def __init__(self, source: str, names: set[str], filters: dict[str, Callable]) -> None:
        self.names, self.filters, self.at = names, filters, 0
        self.tokens, end = [], 0
        source = source.rstrip()
        while end < len(source):
            m = _TOKENS.match(source, end)
            if not m:
                raise TemplateError(f"cannot read {source[end:]!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[0]), text[1:-1], flags=re.DOTALL)))
            elif number is not None:
                self.tokens.append(("value", int(number)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            end = m.end()

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "value" and self.tokens[self.at][1] in words

    def take(self, kind: str, word: str | None = None) -> Any:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or word not in (None, self.tokens[self.at][1]):
            raise TemplateError(f"expected {word or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.peek("or"):
            self.at += 1
            other = self.both()
            node = (node if node.args[0] else other) if node.kind == "const" else Node("or", (node, other))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.peek("and"):
            self.at += 1
            other = self.negated()
            node = (other if node.args[0] else node) if node.kind == "const" else Node("and", (node, other))
        return node

    def negated(self) -> Node:
        if self.peek("not"):
            self.at += 1
            node = self.negated()
            return const(not node.args[0]) if node.kind == "const" else Node("not", (node,))
        return self.compared()

    def compared(self) -> Node:
        node = self.joined()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            node = self.operation(self.tokens[self.at - 1][1], node, self.joined())
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while self.peek("+", "~"):
            self.at += 1
            node = self.operation(self.tokens[self.at - 1][1], node, self.filtered())
        return node

    @staticmethod
    def operation(sign: str, a: Node, b: Node) -> Node:
        if a.kind == b.kind == "const":
            return const(_OPERATORS[sign](a.args[0], b.args[0]))
        return Node("operation", (sign, a, b))

    def filtered(self) -> Node:
        node = self.single()
        while self.peek("|"):
            self.at += 1
            name = self.take("name")
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name}")
            node = const(self.filters[name](node.args[0])) if node.kind == "const" else Node("filter", (name, node))
        return node

    def single(self) -> Node:
        if self.peek("("):
            self.at += 1
            node = self.either()
            self.take("sign", ")")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "value":
            return const(self.take("value"))
        name = self.take("name")
        if name in ("true", "false", "none"):
            return const({"true": True, "false": False, "none": None}[name])
        if name not in self.names:
            raise TemplateError(f"unknown name {name}")
        node = Node("name", (name,))
        while self.peek(".", "["):
            self.at += 1
            if self.tokens[self.at - 1][1] == ".":
                field = self.take("name")
            else:
                field = self.take("value")
                self.take("sign", "]")
            if node.kind != "name" or field not in (LOOP if name == "loop" else FIELDS):
                raise TemplateError(f"unknown field {field}")
            node = Node("field", (name, field))
        if node.kind == "name" and name in ("loop", "messages"):
            raise TemplateError(f"{name} has no value of its own")
        return node


class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable]) -> None:
        self.filters, self.names, self.loop_name = filters, set(), None
        self.parts, end = [], 0
        for m in _PARTS.finditer(source):
            self.parts.append(("text", source[end:m.start()]))
            if m[1] is not None:
                self.parts.append(("print", m[1]))
            elif m[2] is not None:
                self.parts.append(("tag", m[2].strip()))
            end = m.end()
        self.parts.append(("text", source[end:]))
        self.at = 0

    def expression(self, source: str) -> Node:
        return _Expressions(source, self.names, self.filters).whole()

    def block(self, *ends: str, top: bool = False) -> list[Node]:
        """Nodes up to one of the end tags, which is left to the caller; constants joined."""
        out: list[Node] = []

        def add(node: Node) -> None:
            if node.kind == "const":
                value = "" if node.args[0] is None else str(node.args[0])
                if out and out[-1].kind == "const":
                    out[-1] = const(out[-1].args[0] + value)
                elif value:
                    out.append(const(value))
            else:
                out.append(node)

        while self.at < len(self.parts):
            kind, source = self.parts[self.at]
            self.at += 1
            if kind == "text":
                add(const(source))
            elif kind == "print":
                node = self.expression(source)
                add(node if node.kind == "const" else Node("print", (node,)))
            else:
                word = source.split(None, 1)[0] if source else ""
                if word in ends:
                    self.at -= 1
                    return out
                for node in self.tag(word, source, top):
                    add(node)
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out

    def end(self, word: str) -> None:
        if self.at >= len(self.parts) or self.parts[self.at][1] != word:
            raise TemplateError(f"missing {word}")
        self.at += 1

    def tag(self, word: str, source: str, top: bool) -> list[Node]:
        if word == "generation":
            body = self.block("endgeneration")
            self.end("endgeneration")
            return [Node("generation", (body,))]
        if word == "set":
            m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(?!=)(.*)", source, re.DOTALL)
            if not m or m[1] in ("loop", "messages", self.loop_name):
                raise TemplateError(f"cannot set: {source}")
            value = self.expression(m[2])
            self.names.add(m[1])
            return [Node("set", (m[1], value))]
        if word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", source)
            if not m or not top or self.loop_name:
                raise TemplateError("one loop over messages, at the top")
            self.loop_name = m[1]
            outside, self.names = self.names, {m[1], "loop"}
            body = self.block("endfor")
            self.end("endfor")
            self.names = outside
            return [Node("for", (m[1], body))]
        if word == "if":
            return self.choice(source[2:])
        raise TemplateError(f"unknown tag {source}")

    def choice(self, condition: str) -> list[Node]:
        test = self.expression(condition)
        yes = self.block("elif", "else", "endif")
        kind, source = self.parts[self.at]
        self.at += 1
        no: list[Node] = []
        if source.startswith("elif"):
            no = self.choice(source[4:])
        elif source == "else":
            no = self.block("endif")
            self.end("endif")
        if test.kind == "const":
            return yes if test.args[0] else no
        return [Node("if", (test, yes, no))]


class Output:
    """Text with the spans that are to be learned, in code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind, args = node
    if kind == "const":
        value = args[0]
        return lambda scope: value
    if kind == "name":
        name = args[0]
        return lambda scope: scope[name]
    if kind == "field":
        name, field = args
        return lambda scope: scope[name][field]
    if kind == "filter":
        use, inner = filters[args[0]], _value(args[1], filters)
        return lambda scope: use(inner(scope))
    if kind == "not":
        inner = _value(args[0], filters)
        return lambda scope: not inner(scope)
    if kind == "operation":
        sign, a, b = _OPERATORS[args[0]], _value(args[1], filters), _value(args[2], filters)
        return lambda scope: sign(a(scope), b(scope))
    a, b = _value(args[0], filters), _value(args[1], filters)
    return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))


def _writer(nodes: list[Node], filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    steps = [_step(node, filters) for node in nodes]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)
    return steps[0] if len(steps) == 1 else run


def _step(node: Node, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    kind, args = node
    if kind == "const":
        text = args[0]
        return lambda scope, out: out.write(text)
    if kind == "print":
        value = _value(args[0], filters)

        def show(scope: dict, out: Output) -> None:
            shown = value(scope)
            out.write("" if shown is None else str(shown))
        return show
    if kind == "set":
        name, value = args[0], _value(args[1], filters)

        def assign(scope: dict, out: Output) -> None:
            scope[name] = value(scope)
        return assign
    if kind == "generation":
        body = _writer(args[0], filters)

        def learn(scope: dict, out: Output) -> None:
            begin = out.size
            body(scope, out)
            out.spans.append((begin, out.size))
        return learn
    test, yes, no = _value(args[0], filters), _writer(args[1], filters), _writer(args[2], filters)
    return lambda scope, out: (yes if test(scope) else no)(scope, out)


def _mentions_loop(node: Any) -> bool:
    if isinstance(node, Node):
        return node.kind == "field" and node.args[0] == "loop" or any(map(_mentions_loop, node.args))
    return isinstance(node, list) and any(map(_mentions_loop, node))


class Controls:
    """Strings that mark turns. ``escape`` puts a backslash before each in a text, and before a
    backslash; ``unescape`` takes exactly these away."""

    def __init__(self, strings: tuple[str, ...]) -> None:
        either = "|".join(map(re.escape, sorted(strings, key=len, reverse=True)))
        self._mark = re.compile(rf"\\|{either}")
        self._marked = re.compile(rf"\\(\\|{either})")

    def escape(self, text: Any) -> str:
        return self._mark.sub(r"\\\g<0>", "" if text is None else str(text))

    def unescape(self, text: str) -> str:
        return self._marked.sub(r"\1", text)


class Template:
    """A compiled template; ``controls`` are the strings that its ``escape`` filter marks in texts."""

    def __init__(self, source: str, controls: tuple[str, ...] = ()) -> None:
        self.source, self.control_strings = source, tuple(controls)
        self.controls = Controls(self.control_strings)
        filters = {**FILTERS, "escape": self.controls.escape}
        nodes = _Parser(source, filters).block(top=True)
        loops = [i for i, node in enumerate(nodes) if node.kind == "for"]
        at = loops[0] if loops else len(nodes)
        name, body = nodes[at].args if loops else ("m", [])
        self.loop_name, self.needs_position = name, _mentions_loop(body)
        self.has_head, self.has_tail = bool(nodes[:at]), bool(nodes[at + 1:])
        self._head, self._body, self._tail = (
            _writer(x, filters) for x in (nodes[:at], body, nodes[at + 1:]))

    def __reduce__(self):
        return Template, (self.source, self.control_strings)

    def _run(self, step, scope: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        step(scope, out)
        return "".join(out.parts), out.spans

    def head(self) -> tuple[str, list[tuple[int, int]]]:
        return self._run(self._head, {})

    def tail(self) -> tuple[str, list[tuple[int, int]]]:
        return self._run(self._tail, {})

    def message(self, role: str | None, text: str | None, index0: int = 0, length: int = 1) -> tuple[str, list[tuple[int, int]]]:
        """One message's part of the text and its learned spans; null role or text as empty."""
        loop = {"first": index0 == 0, "last": index0 + 1 == length, "index": index0 + 1, "index0": index0, "length": length}
        return self._run(self._body, {self.loop_name: {"role": role or "", "text": text or ""}, "loop": loop})

    def conversation(self, messages: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and spans of a conversation that fits in memory."""
        parts = [self.head(), *(self.message(r, t, i, len(messages)) for i, (r, t) in enumerate(messages)), self.tail()]
        text, spans = [], []
        size = 0
        for part, own in parts:
            spans += [(a + size, b + size) for a, b in own]
            text.append(part)
            size += len(part)
        return "".join(text), spans
