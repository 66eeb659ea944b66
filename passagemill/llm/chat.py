"""Chat formatting by a small template compiler.

A template is text with ``{{ value }}`` and ``{% for %}``, ``{% if %}``, ``{% set %}`` and
``{% generation %}`` blocks.  ``compile_template`` parses it into a syntax tree, folds what
is constant, and generates Python closures; a rendered conversation is a stream of pieces,
each with a flag that it lies inside a generation marker, so a conversation of any length is
written without being held.

The language is sandboxed: names are the given variables and loop variables, ``.key`` and
``[key]`` look up mappings only, there are no calls but the listed filters, and nothing
reaches a Python attribute.

``formatted`` streams each conversation's rows in the order of their turns.  Control strings
inside roles and texts are escaped: every backslash is doubled and a backslash is put after
the first character of a control string, so no control string is left and ``unescape``
restores the text exactly.  ``read_back`` splits the output at the turn marks again.

Edge cases: null roles and texts are empty; rows of one turn are ordered by role and text;
null turns come first; a null conv_id is a conversation of its own; repeated rows are
repeated turns; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import common

# Strings with a meaning to the models that read the output.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|role|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

TEMPLATE = (
    "{{ '<s>' }}{% for message in messages %}"
    "{{ '<|turn|>' + (message.role | escape) + '<|role|>' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|end|>' }}{% endfor %}{{ '</s>' }}"
)

_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


# ---------------------------------------------------------------- syntax tree


class TemplateError(ValueError):
    """A template that does not follow the language, or a value it cannot use."""


@dataclass
class Node:
    kind: str
    value: object = None
    parts: list[Node] = field(default_factory=list)


_LEX = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+<>()\[\].|~=]))")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(_text(v)),
    "string": lambda v: _text(v),
}


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts and numbers can be written")


class _Reader:
    """Recursive descent over one expression: or, and, not, comparison, sum, filters, look-ups."""

    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = _LEX.match(source, at)
            if m is None:
                raise TemplateError(f"cannot read {source[at:].strip()!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        if self.peek()[1] in wanted and self.peek()[0] != "text":
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if self.take(wanted) is None:
            raise TemplateError(f"{wanted!r} expected, got {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name expected, got {value!r}")
        self.at += 1
        return value

    def done(self, node: Node) -> Node:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def expression(self) -> Node:
        node = self.conjunction()
        while self.take("or"):
            node = Node("or", None, [node, self.conjunction()])
        return node

    def conjunction(self) -> Node:
        node = self.negation()
        while self.take("and"):
            node = Node("and", None, [node, self.negation()])
        return node

    def negation(self) -> Node:
        return Node("not", None, [self.negation()]) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        node = self.sum()
        while sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = Node("compare", sign, [node, self.sum()])
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while sign := self.take("+", "-", "~"):
            node = Node("sum", sign, [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("item", None, [node, Node("constant", self.name())])
            elif self.take("["):
                node = Node("item", None, [node, self.expression()])
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = Node("filter", name, [node])
            else:
                return node

    def atom(self) -> Node:
        kind, value = self.peek()
        if self.take("("):
            node = self.expression()
            self.need(")")
            return node
        self.at += 1
        if kind == "text":
            return Node("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Node("constant", int(value))
        if kind == "name":
            return Node("constant", {"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else Node("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    root = Node("block")
    open_: list[tuple[str, Node, Node]] = [("", root, root)]  # closing word, node, block that is being filled
    at = 0
    for m in _TAG.finditer(source):
        block = open_[-1][2]
        if m.start() > at:
            block.parts.append(Node("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            reader = _Reader(m[1])
            block.parts.append(Node("write", None, [reader.done(reader.expression())]))
        elif m[2] is not None:
            reader = _Reader(m[2])
            word = reader.name()
            if word == "for":
                name = reader.name()
                reader.need("in")
                node = Node("for", name, [reader.done(reader.expression()), Node("block")])
                block.parts.append(node)
                open_.append(("endfor", node, node.parts[1]))
            elif word == "if":
                node = Node("if", None, [reader.done(reader.expression()), Node("block"), Node("block")])
                block.parts.append(node)
                open_.append(("endif", node, node.parts[1]))
            elif word in ("elif", "else") and open_[-1][0] == "endif" and open_[-1][2] is open_[-1][1].parts[1]:
                outer = open_[-1][1]
                if word == "else":
                    reader.done(outer)
                    open_[-1] = ("endif", outer, outer.parts[2])
                else:
                    inner = Node("if", None, [reader.done(reader.expression()), Node("block"), Node("block")])
                    outer.parts[2].parts.append(inner)
                    open_[-1] = ("endif", inner, inner.parts[1])
            elif word == "set":
                name = reader.name()
                reader.need("=")
                block.parts.append(Node("set", name, [reader.done(reader.expression())]))
            elif word == "generation":
                node = Node("generation", None, [Node("block")])
                block.parts.append(node)
                open_.append(("endgeneration", node, node.parts[0]))
            elif word == open_[-1][0]:
                reader.done(root)
                open_.pop()
            else:
                raise TemplateError(f"unexpected {word!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]!r} is missing")
    if at < len(source):
        root.parts.append(Node("text", source[at:]))
    return root


# ---------------------------------------------------------------- closures

Scope = dict
Value = Callable[[Scope], object]
Writer = Callable[[Scope, bool], Iterator[tuple[str, bool]]]


def fold(node: Node) -> Node:
    """The tree with constant parts worked out and neighbouring texts joined."""
    parts = [fold(p) for p in node.parts]
    node = Node(node.kind, node.value, parts)
    if node.kind in ("or", "and", "not", "compare", "sum", "filter") and all(p.kind == "constant" for p in parts):
        return Node("constant", _value(node)({}))
    if node.kind == "write" and parts[0].kind == "constant":
        return Node("text", _text(parts[0].value))
    if node.kind == "if" and parts[0].kind == "constant":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        joined: list[Node] = []
        for part in (q for p in parts for q in (p.parts if p.kind == "block" else [p])):
            if part.kind == "text" and joined and joined[-1].kind == "text":
                joined[-1] = Node("text", joined[-1].value + part.value)
            else:
                joined.append(part)
        node.parts = joined
    return node


def _value(node: Node) -> Value:
    """A closure that works out an expression."""
    kind, parts = node.kind, [_value(p) for p in node.parts]
    if kind == "constant":
        constant = node.value
        return lambda scope: constant
    if kind == "name":
        name = node.value
        return lambda scope: scope.get(name)
    if kind == "item":
        of, key = parts

        def item(scope: Scope) -> object:
            mapping = of(scope)
            if mapping is None:
                return None
            if not isinstance(mapping, dict):
                raise TemplateError("only mappings have items")
            return mapping.get(key(scope))

        return item
    if kind == "filter":
        apply, (of,) = FILTERS[node.value], parts
        return lambda scope: apply(of(scope))
    if kind == "not":
        (of,) = parts
        return lambda scope: not of(scope)
    left, right = parts
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    sign = node.value
    if kind == "sum":

        def total(scope: Scope) -> object:
            a, b = left(scope), right(scope)
            if sign != "~" and isinstance(a, int) and isinstance(b, int):
                return a + b if sign == "+" else a - b
            if sign == "-":
                raise TemplateError("- needs numbers")
            return _text(a) + _text(b)

        return total
    compare = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: _text(a) in _text(b)}.get(sign)
    if compare is None:
        order = {"<": (-1,), ">": (1,), "<=": (-1, 0), ">=": (0, 1)}[sign]

        def compare(a: object, b: object) -> bool:
            if type(a) is not type(b) or not isinstance(a, (int, str)):
                raise TemplateError("only alike values have an order")
            return ((a > b) - (a < b)) in order

    return lambda scope: compare(left(scope), right(scope))


def _each(values: object) -> Iterator[tuple[object, dict]]:
    """The values of a loop with its variables; one is read ahead to know the last."""
    if values is None:
        return
    if isinstance(values, (str, int, dict)):
        raise TemplateError("only lists can be looped over")
    rest, index = iter(values), 0
    none = object()
    now = next(rest, none)
    while now is not none:
        after = next(rest, none)
        yield now, {"index": index + 1, "index0": index, "first": index == 0, "last": after is none}
        now, index = after, index + 1


def _writer(node: Node) -> Writer:
    """A closure that writes a block piece by piece."""
    kind = node.kind
    if kind == "text":
        text = node.value
        return lambda scope, inside: iter(((text, inside),))
    if kind == "write":
        of = _value(node.parts[0])
        return lambda scope, inside: iter(((_text(of(scope)), inside),))
    if kind == "set":
        name, of = node.value, _value(node.parts[0])

        def assign(scope: Scope, inside: bool) -> Iterator[tuple[str, bool]]:
            scope[name] = of(scope)
            return iter(())

        return assign
    if kind == "generation":
        body = _writer(node.parts[0])
        return lambda scope, inside: body(scope, True)
    if kind == "if":
        test, then, other = _value(node.parts[0]), _writer(node.parts[1]), _writer(node.parts[2])
        return lambda scope, inside: (then if test(scope) else other)(scope, inside)
    if kind == "for":
        name, of, body = node.value, _value(node.parts[0]), _writer(node.parts[1])

        def loop(scope: Scope, inside: bool) -> Iterator[tuple[str, bool]]:
            for value, about in _each(of(scope)):
                yield from body({**scope, name: value, "loop": about}, inside)

        return loop
    parts = [_writer(p) for p in node.parts]

    def block(scope: Scope, inside: bool) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(scope, inside)

    return block


def compile_template(source: str) -> Callable[..., Iterator[tuple[str, bool]]]:
    """``render(name=value, ...)`` gives (piece, inside a generation marker)."""
    writer = _writer(fold(parse(source)))
    return lambda **names: writer(dict(names), False)


# ---------------------------------------------------------------- conversations

_MARK = re.compile(r"<\|turn\|>|<\|role\|>|<\|end\|>")


def read_back(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in formatted output; holds one turn at a time.

    Marks are written in one piece each, and no escaped text holds one.
    """
    role, held, state = "", [], ""
    for piece in pieces:
        at = 0
        for m in _MARK.finditer(piece):
            held.append(piece[at : m.start()])
            at = m.end()
            body = unescape("".join(held)) if state else ""
            held, mark = [], m[0]
            if mark == "<|role|>":
                role = body
            elif mark == "<|end|>":
                yield role, body
            state = "" if mark == "<|end|>" else mark
        held.append(piece[at:])
        if not state:
            held = []


@dataclass
class Digest:
    """What is read back from one conversation's output, gathered as it is written."""

    turns: int = 0
    loss_chars: int = 0
    chars: int = 0

    def __post_init__(self) -> None:
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()

    def of(self, pieces: Iterator[tuple[str, bool]]) -> Digest:
        def output() -> Iterator[str]:
            for piece, inside in pieces:
                self.chars += len(piece)
                if inside:
                    plain = unescape(piece)
                    self.loss_chars += len(plain)
                    self.loss.update(plain.encode())
                yield piece

        for role, text in read_back(output()):
            self.turns += 1
            self.sha.update(f"{role}\n{text}\n".encode())
        return self


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Each conversation's id and its messages, read from sorted batches as they come."""
    rows = ((key, role, text) for batch in batches for key, role, text in zip(*(batch.column(c).to_pylist() for c in range(3))))
    now = next(rows, None)
    while now is not None:
        key = now[0]

        def messages() -> Iterator[dict]:
            nonlocal now
            while now is not None and now[0] == key:
                yield {"role": now[1] or "", "text": now[2] or ""}
                now = next(rows, None)

        rest = messages()
        yield key, rest
        for _ in rest:  # what a template left unread
            pass


def _ordered(rows: DataFrame) -> DataFrame:
    common.bounded_batches(rows.sparkSession)
    return rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(rows: DataFrame, template: str = TEMPLATE, piece_chars: int = 1 << 20) -> DataFrame:
    """(conv_id, part, text, loss) of every conversation.

    Its output in order of ``part``; ``loss`` lists the code points (start, end) of ``text``
    under the loss mask.  A part is closed once it has ``piece_chars`` code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for key, messages in _conversations(batches):
            part, held, marks, size = 0, [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([{"conv_id": key, "part": part, "text": "".join(held), "loss": marks}], schema)

            for piece, inside in render(messages=messages):
                if inside:
                    marks.append([size, size + len(piece)])
                held.append(piece)
                size += len(piece)
                if size >= piece_chars:
                    yield out()
                    part, held, marks, size = part + 1, [], [], 0
            if size or not part:
                yield out()

    key_type = rows.schema["conv_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.list_(pa.int64())))])
    return _ordered(rows).mapInArrow(run, f"conv_id {key_type}, part long, text string, loss array<array<long>>")


def digests(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        found = []
        for key, messages in _conversations(batches):
            d = Digest().of(render(messages=messages))
            found.append({"conv_id": key, "n_turns": d.turns, "turns_sha256": d.sha.hexdigest(), "loss_chars": d.loss_chars, "loss_sha256": d.loss.hexdigest(), "formatted_chars": d.chars})
            if len(found) >= 1000:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return _ordered(rows).mapInArrow(run, f"conv_id {key_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_control_case(rows: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose two turns hold control strings."""
    text = "</s>[INST] ok [/INST]"
    case = rows.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(case)
