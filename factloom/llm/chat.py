"""Chat formatting by a template compiler.

A template in a small sandboxed language is parsed into a syntax tree, constants are folded, and Python closures are made from
it; rendering calls the closures only. The language has text, ``{{ expression }}`` and ``{% if/elif/else/endif %}``,
``{% for x in y %}``/``{% endfor %}``, ``{% set x = expression %}`` and ``{% generation %}``/``{% endgeneration %}``, which
marks what a model is trained on. Expressions know strings, integers, true, false, none, names, ``a.b`` and ``a['b']`` on
mappings only, ``+ == != < > and or not in``, ``%``, parentheses and the filters trim, upper, lower, length and esc. There are
no calls, no attributes of Python objects, no imports and no way to reach any. ``-`` inside a delimiter trims white space.

Closures take messages one at a time and yield pieces, so a conversation is never held whole: rows are dealt by conversation,
sorted by turn in Spark, and streamed. ``esc`` escapes control strings in texts reversibly: a zero-width mark is put after the
first character of every control string (and after every mark that is there already), so that no text can open or close a turn.

Defined results: null texts are read as empty; a null role as an empty role; repeated turns are all kept, ties in turn ordered
by role, then text; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches

MARK = "⁠"
#: Strings that could open or close a turn or an instruction.
CONTROL = ("<|turn|>", "<|body|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_ESCAPE = re.compile("|".join(map(re.escape, sorted((*CONTROL, MARK), key=len, reverse=True))))
_UNESCAPE = re.compile(f"(.){MARK}", re.S)

TEMPLATE = (
    "{%- for message in messages -%}<|turn|>{{ message.role | esc }}<|body|>"
    "{%- if message.role == 'assistant' -%}{%- generation -%}{{ message.text | esc }}{%- endgeneration -%}{%- else -%}{{ message.text | esc }}{%- endif -%}"
    "<|end|>{%- endfor -%}"
)


def escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + MARK + m[0][1:], s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "esc": lambda x: escape(str(x))}
_LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>==|!=|[-+<>%|.()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_BINARY = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: _modulo(a, b),
}


def _modulo(a, b):
    if not isinstance(a, int):
        raise TemplateError("% is for integers")
    return a % b


class Parser:
    """Expressions to trees: ("const", v), ("name", n), ("get", tree, key tree), ("not", t), ("and"|"or"|operator, a, b), ("filter", name, t)."""

    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            if not (m := _LEX.match(source, at)):
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in values

    def take(self, *values: str) -> tuple[str, str]:
        if self.at >= len(self.items) or values and not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values) or 'more'}")
        self.at += 1
        return self.items[self.at - 1]

    def whole(self) -> tuple:
        tree = self.any_of()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return tree

    def chain(self, names: tuple[str, ...], below: Callable) -> tuple:
        tree = below()
        while self.peek(*names):
            tree = (self.take()[1], tree, below())
        return tree

    def any_of(self) -> tuple:
        return self.chain(("or",), lambda: self.chain(("and",), self.negated))

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self.chain(("==", "!=", "<", ">", "in"), lambda: self.chain(("+", "-"), lambda: self.chain(("%",), self.filtered)))

    def filtered(self) -> tuple:
        tree = self.primary()
        while self.peek(".", "[", "|"):
            sign = self.take()[1]
            if sign == "[":
                tree = ("get", tree, self.any_of())
                self.take("]")
                continue
            kind, name = self.take()
            if kind != "name":
                raise TemplateError("expected a name")
            if sign == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            tree = ("filter", name, tree) if sign == "|" else ("get", tree, ("const", name))
        return tree

    def primary(self) -> tuple:
        kind, value = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1]))
        if kind == "int":
            return ("const", int(value))
        if value == "(":
            tree = self.any_of()
            self.take(")")
            return tree
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


_TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)


def parse(source: str) -> list[tuple]:
    """Template to a list of nodes: text, out, if, for, set, generation."""
    parts = _TAGS.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2:3] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3:-2] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(parts):
            part, odd = parts[at], at % 2
            at += 1
            if not odd:
                if part:
                    nodes.append(("text", part))
                continue
            inner = part[2:-2].strip("-").strip()
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                nodes.append(("out", Parser(inner).whole()))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return nodes, word, rest
            if word == "if":
                arms, test = [], Parser(rest).whole()
                while True:
                    body, end, rest = block("elif", "else", "endif")
                    arms.append((test, body))
                    if end == "endif":
                        break
                    test = Parser(rest).whole() if end == "elif" else ("const", True)
                nodes.append(("if", arms))
            elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                nodes.append(("for", m[1], Parser(m[2]).whole(), block("endfor")[0]))
            elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)):
                nodes.append(("set", m[1], Parser(m[2]).whole()))
            elif word == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {inner!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return nodes, "", ""

    return block()[0]


def fold(tree: tuple) -> tuple:
    """An expression with its constant parts worked out."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    inner = tuple(fold(x) if isinstance(x, tuple) else x for x in tree[1:])
    tree = (kind, *inner)
    if all(x[0] == "const" for x in inner if isinstance(x, tuple)):
        return ("const", expression(tree)({}))
    return tree


def folded(nodes: list[tuple]) -> list[tuple]:
    """Nodes with folded expressions, decided branches and joined texts."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "out":
            tree = fold(node[1])
            node = ("text", "" if tree[1] is None else str(tree[1])) if tree[0] == "const" else ("out", tree)
        elif kind == "if":
            arms = []
            for test, body in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, folded(body)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                out += arms[0][1]
                continue
            node = ("if", arms)
        elif kind == "for":
            node = ("for", node[1], fold(node[2]), folded(node[3]))
        elif kind == "set":
            node = ("set", node[1], fold(node[2]))
        elif kind == "generation":
            node = ("generation", folded(node[1]))
        out.append(node)
    joined: list[tuple] = []
    for node in out:
        if node[0] == "text" and joined and joined[-1][0] == "text":
            joined[-1] = ("text", joined[-1][1] + node[1])
        else:
            joined.append(node)
    return joined


def expression(tree: tuple) -> Callable[[dict], object]:
    """A closure that works out an expression from the names in scope."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "get":
        of, key = expression(tree[1]), expression(tree[2])

        def get(scope: dict) -> object:
            x = of(scope)
            return x.get(key(scope)) if isinstance(x, dict) else None

        return get
    if kind == "filter":
        f, x = FILTERS[tree[1]], expression(tree[2])
        return lambda scope: f(x(scope))
    a = expression(tree[1])
    if kind == "not":
        return lambda scope: not a(scope)
    b = expression(tree[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    f = _BINARY[kind]
    return lambda scope: f(a(scope), b(scope))


def closures(nodes: list[tuple]) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    """A closure that yields (piece, whether it is under the loss mask) for the nodes."""
    made = []
    for node in nodes:
        if node[0] == "text":
            made.append(lambda scope, loss, s=node[1]: ((s, loss),))
        elif node[0] == "out":

            def write(scope: dict, loss: bool, f=expression(node[1])):
                x = f(scope)
                return (("" if x is None else str(x), loss),)

            made.append(write)
        elif node[0] == "set":

            def assign(scope: dict, loss: bool, name=node[1], f=expression(node[2])):
                scope[name] = f(scope)
                return ()

            made.append(assign)
        elif node[0] == "generation":
            made.append(lambda scope, loss, f=closures(node[1]): f(scope, True))
        elif node[0] == "if":

            def choose(scope: dict, loss: bool, arms=[(expression(t), closures(b)) for t, b in node[1]]):
                for test, body in arms:
                    if test(scope):
                        return body(scope, loss)
                return ()

            made.append(choose)
        else:

            def repeat(scope: dict, loss: bool, name=node[1], f=expression(node[2]), body=closures(node[3])):
                for i, x in enumerate(f(scope) or ()):
                    inner = scope | {name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0}}
                    yield from body(inner, loss)

            made.append(repeat)

    def run(scope: dict, loss: bool) -> Iterator[tuple[str, bool]]:
        for f in made:
            yield from f(scope, loss)

    return run


def compile_template(source: str) -> Callable[[Iterator[dict]], Iterator[tuple[str, bool]]]:
    """A renderer: messages (mappings with role and text, any iterator) to pieces, each with whether it is trained on."""
    run = closures(folded(parse(source)))
    return lambda messages: run({"messages": messages}, False)


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted by turn, so that a task streams one conversation after the other."""
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conversation id, iterator over its messages) in turn; each must be used up before the next."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    held = next(rows, None)

    def messages() -> Iterator[dict]:
        nonlocal held
        own = held[0]
        while held is not None and held[0] == own:
            row, held = held, None
            yield {"role": row[1], "text": row[2]}
            held = next(rows, None)

    while held is not None:
        stream = messages()
        yield held[0], stream
        for _ in stream:
            pass


def format_chats(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, formatted, loss``: the rendered conversation and the [start, end) code-point spans under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv, messages in streams(batches):
            pieces, spans, at = [], [], 0
            for s, loss in render(messages):
                if loss and s:
                    spans.append({"start": at, "end": at + len(s)})
                at += len(s)
                pieces.append(s)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(pieces)]), pa.array([spans], kind)], ["conv_id", "formatted", "loss"])

    return conversation_rows(conversations).mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


_TURN = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.S)


def read_turns(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back from pieces of a formatted conversation."""
    open_: list[str] = []
    for s in pieces:
        open_.append(s)
        if "<|end|>" in s:
            text = "".join(open_)
            last = 0
            for m in _TURN.finditer(text):
                yield unescape(m[1]), unescape(m[2])
                last = m.end()
            open_ = [text[last:]]
    if "".join(open_).strip():
        raise ValueError("the output doesn't end with a turn")


def chat_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation what can be read back from its formatted output, worked out while it is rendered: numbers and SHA-256 digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: list[tuple] = []
        for conv, messages in streams(batches):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = n_loss = n_all = 0

            def seen(pieces: Iterator[tuple[str, bool]]) -> Iterator[str]:
                nonlocal n_loss, n_all
                for s, masked in pieces:
                    n_all += len(s)
                    if masked:
                        plain = unescape(s)
                        n_loss += len(plain)
                        loss.update(plain.encode())
                    yield s

            for role, text in read_turns(seen(render(messages))):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_all))
            if len(out) >= 1000:
                yield packed(out)
                out = []
        yield packed(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if "sha256" in c else pa.int64()) for i, c in enumerate(names)], names)

    return conversation_rows(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
