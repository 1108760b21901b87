"""Chat formatting by a template compiler.

A template is text with `{{ expression }}`, `{% for x in messages %}`, `{% if %}`, `{% elif %}`,
`{% else %}` and `{% generation %}` blocks. Expressions know strings, numbers, `true` and
`false`, the names in scope, the fields `role` and `text` of a message, `==`, `!=`, `and`, `or`,
`not`, `+`, parentheses and the filters `escape`,
`escape_line` and `trim` - nothing else, so a template cannot
reach Python. It is parsed into a syntax tree, constants are folded (constant operations,
constant conditions, neighbouring text), and the tree becomes Python closures that write the
pieces of a conversation. What a `generation` block writes is under the loss mask.

`escape` makes a text safe inside the marks and can be undone: the escape character doubles as
`\\0;` and each control string becomes `\\1;`, `\\2;` and so on; `escape_line` also
turns line ends, so that a role stays on its line.

Defined results: rows of a conversation are taken by turn, rows of one turn by role and text;
null role and text are empty; each row with a null conv_id is a conversation of its own; an
empty table gives no rows; other columns are ignored; a template that cannot be read back is
refused before anything runs. A conversation is formatted as a whole, as a training example is;
tasks hold one conversation at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed control strings, those of this template and of usual others.
CONTROLS = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = "{% for m in messages %}<|turn|>{{ m.role | escape_line }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"

_TO_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *sorted(CONTROLS, key=len, reverse=True)))))
_ESCAPED = re.compile(r"\\(\d+);")
_CODES = {c: f"\\{k};" for k, c in enumerate(("\\", *CONTROLS))}
_PLAIN = ("\\", *CONTROLS, "\n")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _CODES[m[0]], text)


def escape_line(text: str) -> str:
    """`escape` for what must stay on one line."""
    return escape(text).replace("\n", f"\\{len(_CODES)};")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[int(m[1])], text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip}
FIELDS = ("role", "text")


class TemplateError(ValueError):
    """A template that the language does not allow."""


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[()|+.]))")


class _Expression:
    """Recursive descent over one expression; nodes are tuples with the kind first."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = ("string", "number", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def parse(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        out = self.joined()
        if self.peek("==", "!="):
            sign = self.tokens[self.at][1]
            self.at += 1
            out = (sign, out, self.joined())
        return out

    def joined(self):
        out = self.filtered()
        while self.take("+"):
            out = ("+", out, self.filtered())
        return out

    def filtered(self):
        out = self.single()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = ("filter", name, out)
        return out

    def single(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return ("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return ("constant", int(value))
        if kind == "sign" and value == "(":
            out = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is not closed")
            return out
        if kind != "name" or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return ("constant", value == "true")
        if self.take("."):
            kind, field = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or field not in FIELDS:
                raise TemplateError(f"no field {field!r}")
            self.at += 1
            return ("field", value, field)
        return ("name", value)


def parse(template: str):
    """The syntax tree of a template: ("block", nodes)."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        parts.append(("put", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    pos = 0

    def block(ends: tuple[str, ...]):
        nonlocal pos
        nodes = []
        while pos < len(parts):
            kind, value = parts[pos]
            pos += 1
            word = value.split(None, 1)[0] if kind == "tag" and value else ""
            if kind == "text":
                nodes.append(("text", value))
            elif kind == "put":
                nodes.append(("put", _Expression(value).parse()))
            elif word in ends:
                return ("block", nodes), value
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", value)
                if not m:
                    raise TemplateError(f"cannot read {value!r}")
                body, _ = block(("endfor",))
                nodes.append(("for", m[1], m[2], body))
            elif word == "if":
                arms, condition = [], _Expression(value[2:]).parse()
                while True:
                    body, end = block(("elif", "else", "endif"))
                    arms.append((condition, body))
                    if end.startswith("elif"):
                        condition = _Expression(end[4:]).parse()
                    elif end == "else":
                        condition = ("constant", True)
                    else:
                        break
                nodes.append(("if", arms))
            elif word == "generation":
                body, _ = block(("endgeneration",))
                nodes.append(("generation", body))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), ""

    return block(())[0]


def fold(node):
    """The same tree with constant parts worked out."""
    kind = node[0]
    if kind in ("constant", "name", "field", "text"):
        return node
    if kind == "filter":
        inner = fold(node[2])
        return ("constant", FILTERS[node[1]](str(inner[1]))) if inner[0] == "constant" else ("filter", node[1], inner)
    if kind == "not":
        inner = fold(node[1])
        return ("constant", not inner[1]) if inner[0] == "constant" else ("not", inner)
    if kind in ("==", "!=", "+", "and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == b[0] == "constant":
            value = {"==": a[1] == b[1], "!=": a[1] != b[1], "and": a[1] and b[1], "or": a[1] or b[1]}.get(kind)
            return ("constant", str(a[1]) + str(b[1]) if kind == "+" else value)
        return (kind, a, b)
    if kind == "put":
        inner = fold(node[1])
        return ("text", str(inner[1])) if inner[0] == "constant" else ("put", inner)
    if kind == "for":
        return ("for", node[1], node[2], fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        arms = []
        for condition, body in node[1]:
            condition = fold(condition)
            if condition[0] == "constant" and not condition[1]:
                continue
            arms.append((condition, fold(body)))
            if condition[0] == "constant":
                break
        return arms[0][1] if arms and arms[0][0][0] == "constant" else ("if", arms)
    nodes: list = []
    for child in map(fold, node[1]):
        for one in child[1] if child[0] == "block" else [child]:
            if one[0] == "text" and nodes and nodes[-1][0] == "text":
                nodes[-1] = ("text", nodes[-1][1] + one[1])
            elif one != ("text", ""):
                nodes.append(one)
    return ("block", nodes)


Scope = dict
Writer = Callable[[Scope, Callable[[str, bool], None], bool], None]


def _value(node) -> Callable[[Scope], object]:
    kind = node[0]
    if kind == "constant":
        return lambda s, v=node[1]: v
    if kind == "name":
        return lambda s, n=node[1]: s.get(n, "")
    if kind == "field":
        return lambda s, n=node[1], k=FIELDS.index(node[2]): s[n][k] if isinstance(s.get(n), tuple) else ""
    if kind == "filter":
        f, inner = FILTERS[node[1]], _value(node[2])
        return lambda s: f(str(inner(s)))
    if kind == "not":
        inner = _value(node[1])
        return lambda s: not inner(s)
    a, b = _value(node[1]), _value(node[2])
    if kind == "==":
        return lambda s: a(s) == b(s)
    if kind == "!=":
        return lambda s: a(s) != b(s)
    if kind == "+":
        return lambda s: str(a(s)) + str(b(s))
    return (lambda s: a(s) and b(s)) if kind == "and" else (lambda s: a(s) or b(s))


def _writer(node) -> Writer:
    kind = node[0]
    if kind == "text":
        return lambda s, put, loss, t=node[1]: put(t, loss)
    if kind == "put":
        value = _value(node[1])
        return lambda s, put, loss: put(str(value(s)), loss)
    if kind == "generation":
        inner = _writer(node[1])
        return lambda s, put, loss: inner(s, put, True)
    if kind == "for":
        name, source, body = node[1], node[2], _writer(node[3])

        def loop(s: Scope, put, loss) -> None:
            for x in s.get(source, ()):
                body(s | {name: x}, put, loss)

        return loop
    if kind == "if":
        arms = [(_value(c), _writer(b)) for c, b in node[1]]

        def choose(s: Scope, put, loss) -> None:
            for condition, body in arms:
                if condition(s):
                    return body(s, put, loss)

        return choose
    children = [_writer(x) for x in node[1]]

    def sequence(s: Scope, put, loss) -> None:
        for child in children:
            child(s, put, loss)

    return sequence


def compile_template(template: str) -> Callable[[list[tuple[str, str]]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (role, text) to the formatted text and its spans under the mask."""
    write = _writer(fold(parse(template)))

    def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        pieces: list[str] = []
        masked: list[tuple[int, int]] = []
        size = 0

        def put(text: str, loss: bool) -> None:
            nonlocal size
            pieces.append(text)
            if loss:
                masked.append((size, size + len(text)))
            size += len(text)

        write({"messages": messages}, put, False)
        return "".join(pieces), masked

    return render


_FIELD_FILTERS = ("escape", "escape_line")
Path = tuple[list[tuple], str | None]


def _paths(node, name: str) -> list[Path]:
    """The ways through a loop's body: pieces ("text", t) or ("field", field, filter), and the role that a way is for."""
    kind = node[0]
    if kind == "text":
        return [([node], None)]
    if kind == "generation":
        return _paths(node[1], name)
    if kind == "put":
        value = node[1]
        if value[0] == "filter" and value[1] in _FIELD_FILTERS and value[2][:2] == ("field", name):
            return [([("field", value[2][2], value[1])], None)]
        raise TemplateError("only escaped fields of a message can be read back")
    if kind == "if":
        out: list[Path] = []
        for condition, body in node[1]:
            own = condition[2][1] if condition[0] == "==" and condition[1] == ("field", name, "role") and condition[2][0] == "constant" else None
            out += [(pieces, own if role is None else role) for pieces, role in _paths(body, name)]
        return out if node[1][-1][0] == ("constant", True) else [*out, ([], None)]
    if kind != "block":
        raise TemplateError(f"{kind} inside the loop over messages cannot be read back")
    ways: list[Path] = [([], None)]
    for child in node[1]:
        ways = [(pieces + more, role if own is None else own) for pieces, role in ways for more, own in _paths(child, name)]
    return ways


def _way_pattern(pieces: list[tuple], role: str | None) -> re.Pattern:
    """Of one way, the expression that reads its fields back."""
    joined = fold(("block", pieces))[1] if pieces else []
    out, seen = "", set()
    for piece, after in zip(joined, [*joined[1:], None]):
        if piece[0] == "text":
            out += re.escape(piece[1])
        elif piece[1] in seen:
            out += f"(?P={piece[1]})"
        else:
            ends = after is not None and after[0] == "text" and after[1].startswith(CONTROLS if piece[2] == "escape" else (*CONTROLS, "\n"))
            if not ends:
                raise TemplateError(f"nothing ends the {piece[1]} of a message")
            seen.add(piece[1])
            out += f"(?P<{piece[1]}>.*?)"
    if "text" not in seen or ("role" not in seen and role is None):
        raise TemplateError("a message's role or text cannot be read back")
    return re.compile(out, re.S)


def compile_reader(template: str) -> Callable[[str], list[tuple[str, str]]]:
    """The function from what a template has formatted back to the messages (role, text).

    A template can be read back if it is one loop over the messages between constant texts, and if
    each way through the loop shows the role, or is for one role, and shows the text, both escaped and
    followed by a control string (an escaped line: or by a line end). Otherwise TemplateError."""
    nodes = fold(parse(template))[1]
    loops = [k for k, n in enumerate(nodes) if n[0] == "for"]
    if len(loops) != 1 or any(n[0] not in ("text", "for") for n in nodes) or nodes[loops[0]][2] != "messages":
        raise TemplateError("a template is read back by its one loop over the messages")
    _, name, _, body = nodes[loops[0]]
    head, tail = ("".join(n[1] for n in part) for part in (nodes[: loops[0]], nodes[loops[0] + 1 :]))
    ways = [(_way_pattern(pieces, role), role) for pieces, role in _paths(body, name)]
    one = _writer(body)

    def again(message: tuple[str, str]) -> str:
        pieces: list[str] = []
        one({name: message}, lambda text, loss: pieces.append(text), False)
        return "".join(pieces)

    def read(formatted: str) -> list[tuple[str, str]]:
        out, at, end = [], len(head), len(formatted) - len(tail)
        while at < end:
            for pattern, role in ways:
                m = pattern.match(formatted, at, end)
                if m is None:
                    continue
                found = m.groupdict()
                message = (unescape(found["role"]) if "role" in found else role, unescape(found["text"]))
                if m.end() > at and again(message) == m[0]:
                    break
            else:
                raise ValueError("not a text of this template")
            out.append(message)
            at = m.end()
        return out

    return read


def read_back(formatted: str, template: str = TEMPLATE) -> list[tuple[str, str]]:
    """The turns of a text that the template formatted."""
    return compile_reader(template)(formatted)


def _format(template: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, read = compile_template(template), compile_reader(template)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"] + ["formatted", "loss_spans"] * with_text
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.string(), pa.list_(pa.list_(pa.int64()))] * with_text
        done: list[list] = [[] for _ in names]
        now, turns = None, []

        def finish() -> None:
            text, masked = render(turns)
            back = read(text)
            loss = "".join(unescape(text[a:b]) for a, b in masked)
            said = "".join(f"{role}\n{said}\n" for role, said in back)
            row = [now, len(back), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)]
            for column, value in zip(done, row + [text, [list(x) for x in masked]] * with_text):
                column.append(value)

        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if turns and (conv != now or conv is None):
                    finish()
                    turns = []
                now = conv
                turns.append((role or "", text or ""))
            if len(done[0]) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names=names)
                done = [[] for _ in names]
        if turns:
            finish()
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names=names)

    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, with_text: bool = False) -> DataFrame:
    """One row per conversation, read back from the formatted text."""
    compile_template(template), compile_reader(template)  # a wrong template fails here
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("role", "text", "turn"))
    rows = conversations.select("conv_id", "role", "text", "turn").repartition("conv_id", spread).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(_format(template, with_text), kind + ", formatted string, loss_spans array<array<long>>" * with_text)
