"""Chat formatting by a compiled template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that yield
pieces of output, each with the mark whether it lies in a generation block.  The language knows no calls, no
attributes of Python objects and no names but those given to it, so a template can do nothing but render.

    {{ expr }}                          output
    {% for x in expr %} ... {% endfor %}      with loop.first, loop.last, loop.index, loop.index0
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% set name = expr %}
    {% generation %} ... {% endgeneration %}   output under the loss mask
    {# comment #}

Expressions: strings, integers, true, false, none, names, ``a.b`` and ``a['b']`` (keys of mappings only), ``+ ~ == != < >
<= >= in and or not``, parentheses, ``x if c else y`` and the filters ``|trim |upper |lower |length |escape``.
``escape`` makes control strings in a text harmless in a way that ``unescape`` reverses.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Piece = tuple[str, bool]
Scope = dict[str, object]
Render = Callable[[Scope, bool], Iterator[Piece]]

#: What the default template writes around turns, and what ``escape`` breaks up inside texts.
TURN, ROLE_END, TURN_END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, ROLE_END, TURN_END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
#: Put after the first character of a control string, and after the first of such a string already escaped, once more.
BREAK = "⁠"
CHAT = (
    "{# marks turns; assistant texts are under the loss mask #}"
    "{% for m in messages %}" + TURN + "{{ m.role|escape }}" + ROLE_END + "{% if m.role == 'assistant' %}"
    "{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}" + TURN_END + "{% endfor %}"
)

_ALL = "|".join(re.escape(c[0]) + BREAK + "*" + re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_MAKE, _UNDO = re.compile(_ALL), re.compile(_ALL.replace(BREAK + "*", BREAK + "+"))


def escape(text: str) -> str:
    """One more BREAK in each control string, broken or not: what is left holds no whole one."""
    return _MAKE.sub(lambda m: m[0][0] + BREAK + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: m[0][0] + m[0][2:], text)


FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "escape": lambda x: escape(str(x))}


class TemplateError(ValueError):
    pass


# --- Syntax tree ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    """An operation; ``kind``: an operator, 'key', 'filter:<name>', 'not' or 'choice'."""

    kind: str
    parts: tuple


@dataclass(frozen=True)
class Node:
    """'out' (expr), 'for' (name, expr, body), 'if' ((test, body) ...), 'set' (name, expr), 'generation' (body)."""

    kind: str
    parts: tuple


BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "~": lambda a, b: _shown(a) + _shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}
LEVELS = (("or",), ("and",), ("==", "!=", "<=", ">=", "<", ">", "in"), ("~",), ("+",))
_TOKEN = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>().,|\[\]=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _shown(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


class Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            number, single, double, word, sign = m.groups()
            text = single if single is not None else double
            self.tokens.append(("const", int(number)) if number else ("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text)) if text is not None else ("word", word) if word else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def take(self, *values: str):
        if self.at >= len(self.tokens) or values and not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def choice(self):
        value = self.level(0)
        if not self.peek("if"):
            return value
        self.take()
        test = self.level(0)
        self.take("else")
        return _folded(Op("choice", (test, value, self.choice())))

    def level(self, n: int):
        if n == len(LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.peek(*LEVELS[n]):
            left = _folded(Op(self.take()[1], (left, self.level(n + 1))))
        return left

    def unary(self):
        if self.peek("not"):
            self.take()
            return _folded(Op("not", (self.unary(),)))
        value = self.atom()
        while self.peek(".", "[", "|"):
            sign = self.take()[1]
            if sign == "|":
                name = self.take()[1]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = _folded(Op(f"filter:{name}", (value,)))
            elif sign == ".":
                kind, key = self.take()
                if kind != "word":
                    raise TemplateError("a key must follow the dot")
                value = Op("key", (value, Const(key)))
            else:
                value = Op("key", (value, self.choice()))
                self.take("]")
        return value

    def atom(self):
        kind, value = self.take()
        if kind == "const":
            return Const(value)
        if kind == "word":
            return Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        if value == "(":
            inner = self.choice()
            self.take(")")
            return inner
        raise TemplateError(f"unexpected {value!r}")


def _folded(op: Op):
    """``op``, or its value where all that it needs is constant."""
    if all(isinstance(x, Const) for x in op.parts):
        try:
            return Const(_evaluator(op)({}))
        except Exception as e:
            raise TemplateError(f"{op.kind}: {e}") from e
    if op.kind in ("and", "or") and isinstance(op.parts[0], Const):
        return op.parts[1] if bool(op.parts[0].value) == (op.kind == "and") else op.parts[0]
    if op.kind == "choice" and isinstance(op.parts[0], Const):
        return op.parts[1] if op.parts[0].value else op.parts[2]
    return op


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)


def parse(source: str) -> tuple[Node, ...]:
    """The syntax tree, constants folded."""
    items: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        items += [("text", source[at : m.start()])] * (m.start() > at)
        items += [("out", m[1])] if m[1] is not None else [("tag", m[2].strip())] if m[2] is not None else []
        at = m.end()
    items += [("text", source[at:])] * (at < len(source))
    body, rest = _block(items, 0, ())
    if rest < len(items):
        raise TemplateError(f"unexpected {items[rest][1]!r}")
    return body


def _block(items: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[tuple[Node, ...], int]:
    """Nodes up to a tag of ``ends``, and its place."""
    out: list[Node] = []
    while at < len(items):
        kind, text = items[at]
        word, _, rest = text.partition(" ") if kind == "tag" else ("", "", "")
        if kind == "tag" and word in ends:
            return _joined(out), at
        at += 1
        if kind == "text":
            out.append(Node("out", (Const(text),)))
        elif kind == "out":
            out.append(Node("out", (Expression(text).whole(),)))
        elif word == "for":
            name, _, source = rest.partition(" in ")
            if not name.strip().isidentifier():
                raise TemplateError(f"no name to loop with: {rest!r}")
            body, at = _block(items, at, ("endfor",))
            out.append(Node("for", (name.strip(), Expression(source).whole(), body)))
            at += 1
        elif word == "if":
            arms, test, more = [], Expression(rest).whole(), True
            while more:
                body, at = _block(items, at, ("elif", "else", "endif"))
                arms.append((test, body))
                word, _, rest = items[at][1].partition(" ")
                more = word != "endif"
                test = Expression(rest).whole() if word == "elif" else Const(True)
                at += 1
            out.append(Node("if", tuple(arms)))
        elif word == "set":
            name, _, source = rest.partition("=")
            out.append(Node("set", (name.strip(), Expression(source).whole())))
        elif word == "generation":
            body, at = _block(items, at, ("endgeneration",))
            out.append(Node("generation", (body,)))
            at += 1
        else:
            raise TemplateError(f"no such tag: {text!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return _joined(out), at


def _joined(nodes: list[Node]) -> tuple[Node, ...]:
    """Neighbouring constant outputs as one; branches that constants decide are decided."""
    out: list[Node] = []
    rest = list(reversed(nodes))
    while rest:
        node = rest.pop()
        if node.kind == "if":
            arms = [(t, b) for t, b in node.parts if not (isinstance(t, Const) and not t.value)]
            if not arms or isinstance(arms[0][0], Const):
                rest.extend(reversed(arms[0][1] if arms else ()))
                continue
            node = Node("if", tuple(arms))
        if out and _constant(node) and _constant(out[-1]):
            out[-1] = Node("out", (Const(_shown(out[-1].parts[0].value) + _shown(node.parts[0].value)),))
        else:
            out.append(node)
    return tuple(out)


def _constant(node: Node) -> bool:
    return node.kind == "out" and isinstance(node.parts[0], Const)


# --- Closures --------------------------------------------------------------------------------------------------


def _evaluator(e) -> Callable[[Scope], object]:
    if isinstance(e, Const):
        return lambda scope, value=e.value: value
    if isinstance(e, Name):
        return lambda scope, name=e.name: scope.get(name)
    parts = [_evaluator(x) for x in e.parts]
    if e.kind == "key":
        return lambda scope: _key(parts[0](scope), parts[1](scope))
    if e.kind == "not":
        return lambda scope: not parts[0](scope)
    if e.kind == "choice":
        return lambda scope: parts[1](scope) if parts[0](scope) else parts[2](scope)
    if e.kind in ("and", "or"):
        both = e.kind == "and"
        return lambda scope: parts[1](scope) if bool(first := parts[0](scope)) == both else first
    if e.kind.startswith("filter:"):
        return lambda scope, f=FILTERS[e.kind[7:]]: f(parts[0](scope))
    return lambda scope, f=BINARY[e.kind]: f(parts[0](scope), parts[1](scope))


def _key(value: object, key: object) -> object:
    return value.get(key) if isinstance(value, dict) else None


def _renderer(nodes: tuple[Node, ...]) -> Render:
    runs = [_node(n) for n in nodes]

    def render(scope: Scope, masked: bool) -> Iterator[Piece]:
        for run in runs:
            yield from run(scope, masked)

    return render


def _node(node: Node) -> Render:
    if node.kind == "out":
        value = _evaluator(node.parts[0])

        def out(scope: Scope, masked: bool) -> Iterator[Piece]:
            if text := _shown(value(scope)):
                yield text, masked

        return out
    if node.kind == "set":
        name, value = node.parts[0], _evaluator(node.parts[1])

        def put(scope: Scope, masked: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return put
    if node.kind == "generation":
        inner = _renderer(node.parts[0])
        return lambda scope, masked: inner(scope, True)
    if node.kind == "if":
        arms = [(_evaluator(t), _renderer(b)) for t, b in node.parts]

        def choose(scope: Scope, masked: bool) -> Iterator[Piece]:
            for test, body in arms:
                if test(scope):
                    yield from body(scope, masked)
                    return

        return choose
    name, value, body = node.parts[0], _evaluator(node.parts[1]), _renderer(node.parts[2])

    def loop(scope: Scope, masked: bool) -> Iterator[Piece]:
        rest, index, none = iter(value(scope) or ()), 0, object()
        item = next(rest, none)
        while item is not none:  # one item ahead: a conversation is never held whole
            after = next(rest, none)
            inner = scope | {name: item, "loop": {"first": index == 0, "last": after is none, "index": index + 1, "index0": index}}
            yield from body(inner, masked)
            item, index = after, index + 1

    return loop


def compiled(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """``render(messages)``: yields (text, in a generation block?); messages may be an iterator."""
    run = _renderer(parse(source))
    return lambda messages, **names: run(names | {"messages": messages}, False)


# --- Conversations --------------------------------------------------------------------------------------------

FORMATTED = "conv_id long, part long, formatted string, spans array<struct<start: int, stop: int>>, last boolean"
#: Characters of a part: a longer conversation has several rows.
PART_CHARS = 1 << 20


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of rows sorted by conversation and turn, as streams; each must be read to its end before the next."""
    rows = ((c, {"role": r or "", "text": t or "", "turn": n}) for b in batches for c, n, r, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text")), strict=True))
    ahead = next(rows, None)

    def stream(conv: int | None) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            yield ahead[1]
            ahead = next(rows, None)

    while ahead is not None:
        conv = ahead[0]
        own = stream(conv)
        yield conv, own
        for _ in own:
            pass


def format_conversations(conversations: DataFrame, template: str = CHAT, part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, part, formatted, spans, last``: the rendered conversation and its loss spans, in code points of the part.

    Rows of ``conv_id, turn, role, text``; turns are taken in the order of ``turn`` (ties: role, then text). A null role or text is
    empty; rows without ``conv_id`` are one conversation without an id.  Other columns are not read.  A part ends at a piece of output
    once it has ``part_chars`` code points, so a conversation of any length takes bounded memory: rows come sorted
    and are rendered as a stream.
    """
    render = compiled(template)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0
        for conv, messages in _conversations(batches):
            texts, spans, at, part = [], [], 0, 0
            for text, masked in render(messages):
                if at >= part_chars:
                    done.append((conv, part, "".join(texts), spans, False))
                    size += at
                    texts, spans, at, part = [], [], 0, part + 1
                    if size >= part_chars:
                        yield _formatted(done)
                        done, size = [], 0
                if masked:
                    if spans and spans[-1]["stop"] == at:
                        spans[-1]["stop"] += len(text)
                    else:
                        spans.append({"start": at, "stop": at + len(text)})
                texts.append(text)
                at += len(text)
            done.append((conv, part, "".join(texts), spans, True))
            size += at
            if size >= part_chars:
                yield _formatted(done)
                done, size = [], 0
        if done:
            yield _formatted(done)

    return rows.mapInArrow(run, FORMATTED)


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "formatted", "spans", "last"])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Reads turns back from formatted text that comes in parts."""

    def __init__(self):
        self.turns, self.n, self.chars, self.loss_chars, self.loss, self.open, self.masked = hashlib.sha256(), 0, 0, 0, hashlib.sha256(), "", ""

    def feed(self, text: str, spans: list[dict]) -> None:
        if self.masked and not (spans and spans[0]["start"] == 0):
            self._close()
        self.chars += len(text)
        self.open += text
        *whole, self.open = self.open.split(TURN_END)
        for turn in whole:
            role, _, said = turn.removeprefix(TURN).partition(ROLE_END)
            self.turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        for s in spans:
            # A span that reaches the end of its part may go on in the next one.
            self.masked += text[s["start"] : s["stop"]]
            if s["stop"] < len(text):
                self._close()

    def _close(self) -> None:
        plain = unescape(self.masked)
        self.loss_chars += len(plain)
        self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.masked = ""

    def row(self, conv: int | None) -> tuple:
        self._close()
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` wrote with the template ``CHAT``, read from its text and spans alone.

    Reads the parts of each conversation in the order in which they were written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            out = []
            for conv, text, spans, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans", "last")), strict=True):
                reader.feed(text, spans)
                if last:
                    out.append(reader.row(conv))
                    reader = _Reader()
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, DIGEST)
