"""Chat formatting: a compiler for a small, sandboxed template language.

    {% for m in messages %}{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}
    {% endgeneration %}{% elif ... %}{% else %}{% endif %}{% endfor %}   {% set x = ... %}   {# note #}

``{%-`` and ``-%}`` (also for ``{{``) strip the white space beside them. Expressions
have text, whole numbers, true, false, none, names, ``a.b`` and ``a["b"]`` on mappings
and lists, ``+ ~ == != < <= > >= in not and or``, parentheses and the filters of
``FILTERS``. Inside a loop there are loop.index, loop.index0, loop.first, loop.last. No
attribute or method of a Python object can be reached, nothing is called but filters,
and loops run over what they are given: every template ends.

``compile_template`` parses to a syntax tree, folds constant expressions, branches and
neighbouring texts, and turns each node into a Python closure. Closures are generators:
they hand on (text, is generation) piece by piece and read the messages one by one, so
a conversation is never held whole.

``escape`` puts a backslash after each sign that opens a control string and doubles
backslashes; no control string is left, and ``unescape`` gives the text back.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches

OPENERS = "<["
#: Marks every turn; control strings are <s>, </s>, [INST] and [/INST].
TURNS = ("{% for m in messages %}<s>[INST] {{ m.role | escape }} [/INST]{% if m.role == 'assistant' %}"
         "{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}")
#: Code points after which a formatted piece is handed on.
PIECE = 1 << 16


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return re.sub(r"[<\[]", lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\|\\(\\)", lambda m: m[1] or m[2], text)


def _text(value) -> str:
    return "" if value is None else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable] = {"escape": lambda v: escape(_text(v)), "trim": lambda v: _text(v).strip(),
                                "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
                                "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0}
BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "~": lambda a, b: _text(a) + _text(b), "==": operator.eq, "!=": operator.ne,
    **{s: (lambda f: lambda a, b: type(a) is type(b) and f(a, b))(f)
       for s, f in (("<", operator.lt), ("<=", operator.le), (">", operator.gt), (">=", operator.ge))},
    "in": lambda a, b: isinstance(b, (list, dict)) and a in b or isinstance(a, str) and isinstance(b, str) and a in b}
LEVELS = [("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~")]

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|=]))""")
_TAG = re.compile(r"\{%(-?)(.*?)(-?)%\}|\{\{(-?)(.*?)(-?)\}\}|\{#.*?#\}", re.S)


# --- syntax tree: tuples (kind, ...) -------------------------------------------------

class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def parse(self, level: int = 0) -> tuple:
        if level == len(LEVELS):
            return self.primary()
        if LEVELS[level] == ("not",):
            return ("not", self.parse(level)) if self.take("not") else self.parse(level + 1)
        left = self.parse(level + 1)
        while sign := self.take(*LEVELS[level]):
            left = (sign if sign in ("and", "or") else "binary", *(() if sign in ("and", "or") else (sign,)), left, self.parse(level + 1))
        return left

    def primary(self) -> tuple:
        if self.take("("):
            node = self.parse()
            self.need(")")
        else:
            if self.at >= len(self.tokens):
                raise TemplateError("an expression is missing")
            kind, value = self.tokens[self.at]
            if kind == "op":
                raise TemplateError(f"unexpected {value!r}")
            self.at += 1
            constants = {"true": True, "false": False, "none": None}
            if kind == "text":
                node = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
            elif kind == "num":
                node = ("const", int(value))
            else:
                node = ("const", constants[value]) if value in constants else ("name", value)
        while sign := self.take(".", "[", "|"):
            if sign == ".":
                node = ("item", node, ("const", self.name()))
            elif sign == "[":
                node = ("item", node, self.parse())
                self.need("]")
            else:
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", name, node)
        return node


def _whole(source: str) -> tuple:
    expression = _Expression(source)
    node = expression.parse()
    expression.end()
    return node


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", [nodes])."""
    root: list = []
    stack: list[tuple] = [("block", root, None)]  # (kind, list that grows, data)
    at, strip = 0, False

    def text(raw: str, strip_left: bool, strip_right: bool) -> None:
        raw = raw.lstrip() if strip_left else raw
        raw = raw.rstrip() if strip_right else raw
        if raw:
            stack[-1][1].append(("text", raw))

    for m in _TAG.finditer(source):
        text(source[at:m.start()], strip, (m[1] or m[4]) == "-")
        at, strip = m.end(), (m[3] or m[6]) == "-"
        if m[5] is not None:
            stack[-1][1].append(("out", _whole(m[5])))
        elif m[2] is not None:
            words = _Expression(m[2])
            word = words.name()
            if word == "for":
                name = words.name()
                words.need("in")
                body: list = []
                stack[-1][1].append(("for", name, words.parse(), ("block", body)))
                stack.append(("for", body, None))
            elif word == "if":
                branches = [(words.parse(), [])]
                stack[-1][1].append(("if", branches))
                stack.append(("if", branches[0][1], branches))
            elif word in ("elif", "else"):
                kind, _, branches = stack[-1]
                if kind != "if" or branches is None:  # none once there was an else
                    raise TemplateError(f"{word} without if")
                branches.append((words.parse() if word == "elif" else ("const", True), []))
                stack[-1] = ("if", branches[-1][1], branches if word == "elif" else None)
            elif word == "set":
                name = words.name()
                words.need("=")
                stack[-1][1].append(("set", name, words.parse()))
            elif word == "generation":
                body = []
                stack[-1][1].append(("generation", ("block", body)))
                stack.append(("generation", body, None))
            elif word.startswith("end") and stack[-1][0] == word[3:] != "block":
                stack.pop()
            else:
                raise TemplateError(f"unexpected tag {word!r}")
            words.end()
    text(source[at:], strip, False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return ("block", root)


# --- constant folding ------------------------------------------------------------------

def fold(node: tuple) -> tuple:
    """The same tree with constant expressions computed, decided branches taken, texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "block":
        out: list = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "out" and y[1][0] == "const":
                    y = ("text", _text(y[1][1]))
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("block", out)
    if kind == "if":
        kept = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            kept.append((test, fold(("block", body))[1]))
            if test[0] == "const":
                break
        if kept and kept[0][0][0] == "const":
            return ("block", kept[0][1])
        return ("if", kept) if kept else ("block", [])
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)) and kind in ("not", "and", "or", "binary", "filter", "item"):
        return ("const", _value(parts)({}))
    return parts


# --- closures ----------------------------------------------------------------------------

def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "not":
        return lambda env, f=_value(node[1]): not f(env)
    if kind in ("and", "or"):
        a, b = _value(node[1]), _value(node[2])
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    if kind == "binary":
        f, a, b = BINARY[node[1]], _value(node[2]), _value(node[3])
        return lambda env: f(a(env), b(env))
    if kind == "filter":
        f, a = FILTERS[node[1]], _value(node[2])
        return lambda env: f(a(env))
    a, b = _value(node[1]), _value(node[2])

    def item(env):
        of, key = a(env), b(env)
        if isinstance(of, dict):
            return of.get(key)
        return of[key] if isinstance(of, list) and isinstance(key, int) and -len(of) <= key < len(of) else None

    return item


def _run(node: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":
        def text(env, marked, v=node[1]):
            yield v, marked
        return text
    if kind == "out":
        def out(env, marked, f=_value(node[1])):
            yield _text(f(env)), marked
        return out
    if kind == "set":
        def put(env, marked, n=node[1], f=_value(node[2])):
            env[n] = f(env)
            yield from ()
        return put
    if kind == "generation":
        return lambda env, marked, f=_run(node[1]): f(env, True)
    if kind == "if":
        branches = [(_value(t), _run(("block", b))) for t, b in node[1]]

        def choose(env, marked):
            for test, body in branches:
                if test(env):
                    yield from body(env, marked)
                    return
        return choose
    if kind == "for":
        name, of, body = node[1], _value(node[2]), _run(node[3])

        def loop(env, marked):
            values = of(env)
            if not isinstance(values, Iterable) or isinstance(values, (str, dict)):
                return
            outer = {n: env.get(n) for n in (name, "loop")}
            rest, i = iter(values), 0
            value = next(rest, rest)
            while value is not rest:
                ahead = next(rest, rest)  # one message ahead, to know the last
                env[name] = value
                env["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": ahead is rest}
                yield from body(env, marked)
                value, i = ahead, i + 1
            env.update(outer)
        return loop
    parts = [_run(x) for x in node[1]]

    def block(env, marked):
        for part in parts:
            yield from part(env, marked)
    return block


def compile_template(source: str) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the template's variables that yields (text, is generation)."""
    body = _run(fold(parse(source)))
    return lambda **variables: body(dict(variables), False)


def render(source: str, **variables) -> tuple[str, list[tuple[int, int]]]:
    """Whole output of a template and the spans under generation markers."""
    out, spans, at = [], [], 0
    for text, marked in compile_template(source)(**variables):
        if marked and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


# --- Spark -------------------------------------------------------------------------------

def _rows(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(key, its rows) of rows sorted by their first field, read as they come."""
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                now, ahead = ahead, next(rows, None)
                yield now

        group = own()
        yield key, group
        for _ in group:  # what the template did not read
            pass


def format_conversations(rows: DataFrame, template: str = TURNS, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """The formatted conversations: conv, part, formatted, spans (array of [start, end) under the mask, in this part).

    Turns come by number, ties by role and text, null first; repeated rows are repeated turns.
    Null roles and texts are empty. Null is a conversation id like any other. A part ends
    after ``PIECE`` code points at the end of an output, so a long conversation is
    many rows; parts are numbered from 0. An empty table gives no rows.
    """
    small_batches(rows)
    told = pick(rows, conv=conv, turn=turn, role=role, text=text)
    kind = told.schema["conv"].dataType.simpleString()
    sorted_rows = told.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, types, out = compile_template(template), [], [[], [], [], []]

        def first(batches):
            for batch in batches:
                types[:] = [batch.column("conv").type]
                yield batch

        def table():
            found = pa.RecordBatch.from_arrays(
                [pa.array(out[0], types[0]), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.list_(pa.list_(pa.int64())))], ["conv", "part", "formatted", "spans"])
            for c in out:
                c.clear()
            return found

        for key, group in _groups(_rows(first(batches), ["conv", "role", "text"])):
            parts, spans, at, number = [], [], 0, 0

            def close():
                for c, v in zip(out, (key, number, "".join(parts), spans)):
                    c.append(v)

            for piece, marked in make(messages=({"role": r or "", "text": t or ""} for _, r, t in group)):
                if marked and piece:
                    spans.append([at, at + len(piece)])
                parts.append(piece)
                at += len(piece)
                if at >= PIECE:
                    close()
                    parts, spans, at, number = [], [], 0, number + 1
                    yield table()
            if parts or not number:
                close()
            if len(out[0]) >= 1000:
                yield table()
        if out[0]:
            yield table()

    found = sorted_rows.mapInArrow(run, f"conv {kind}, part long, formatted string, spans array<array<bigint>>")
    return found.toDF(conv, "part", "formatted", "spans")


_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the output of ``format_conversations`` with ``TURNS`` says, straight from it, in its order.

    conv, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars,
    loss_sha256 (text under the mask) and formatted_chars.
    """
    kind = formatted.schema[conv].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, out = [], []

        def first(batches):
            for batch in batches:
                types[:] = [batch.column("conv").type]
                yield batch

        def table():
            columns = list(zip(*out))
            out.clear()
            kinds = [types[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for key, group in _groups(_rows(first(batches), ["conv", "formatted", "spans"])):
            turns, loss, n, loss_chars, chars, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for _, text, spans in group:
                chars += len(text)
                for a, b in spans:
                    plain = unescape(text[a:b])
                    loss_chars += len(plain)
                    loss.update(plain.encode("utf-8", "surrogatepass"))
                rest, at = rest + text, 0
                for m in _TURN.finditer(rest):
                    for part in (m[1], m[2]):
                        turns.update((unescape(part) + "\n").encode("utf-8", "surrogatepass"))
                    n, at = n + 1, m.end()
                rest = rest[at:]
            out.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield table()
        if out:
            yield table()

    flat = formatted.select(F.col(conv).alias("conv"), "formatted", "spans")
    return flat.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                "formatted_chars long").toDF(conv, *names[1:])
