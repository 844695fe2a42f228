"""The expression language of rule specifications, compiled to Columns.

A small language in the manner of JSONata: ``value``, ``source``, ``record.x``
and ``meta.x`` are bound; variables, conditionals, arrays, objects, regular
expressions and the functions of ``FUNCTIONS`` are known.  ``compiled`` gives
the kind of the result, its Column, and a Column that says where evaluation
fails, so that a rule's error policy can be a plan as well.  Kinds are told
when the expression is compiled: a column of texts gives texts.  What the
language has beyond this is refused by name with the code ``compile_error``.

A null in a record is a null; what an index, a lookup or a conditional without
its second half does not find is missing.  Functions of text fail on a null
and pass on what is missing.  ``$match`` gives the first match only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.functions import phone, similarity, text

#: Largest number of operations an expression may unfold to; variables are unfolded where they are used.
MOST = 50_000


class ExpressionError(ValueError):
    """An expression that is not understood; ``code`` is compile_error."""

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} at {at}")
        self.code = "compile_error"


# Syntax: a token is (kind, value, place); a tree is a tuple whose first item names it.

TOKEN = re.compile(r"""\s+|/\*.*?\*/|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<variable>\$[A-Za-z_]\w*|\$\$?)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<sign>:=|!=|<=|>=|~>|\*\*|\.\.|[-+*/%&=<>?:;,.()\[\]{}|^@#])""", re.S)
REGEX = re.compile(r"/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[\n])+)/([a-z]*)")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
BINDS = {".": 75, "[": 80, "(": 80, "*": 60, "/": 60, "%": 60, "+": 50, "-": 50, "&": 50, "=": 40, "!=": 40, "<": 40, ">": 40, "<=": 40, ">=": 40, "in": 40, "and": 30, "or": 25, "?": 20, ":=": 10}


def unescaped(quoted: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), quoted[1:-1], flags=re.S)


class Parser:
    def __init__(self, source: str):
        self.source, self.at, self.place = source, 0, 0
        self.token: tuple[str, Any] = ("", None)
        self.step(False)

    def step(self, operand_before: bool) -> None:
        """Go to the next token; a slash opens a regular expression where an operand is due."""
        while self.at < len(self.source):
            self.place = self.at
            if not operand_before and (m := REGEX.match(self.source, self.at)) and not self.source.startswith("/*", self.at):
                self.at, self.token = m.end(), ("regex", (m[1], m[2]))
                return
            if not (m := TOKEN.match(self.source, self.at)):
                raise ExpressionError(f"unexpected {self.source[self.at]!r}", self.at)
            self.at = m.end()
            if m.lastgroup:
                self.token = (m.lastgroup, m[0])
                return
        self.place, self.token = self.at, ("end", None)

    def sign(self) -> str | None:
        kind, value = self.token
        return value if kind == "sign" or kind == "name" and value in ("and", "or", "in") else None

    def take(self, sign: str, operand_before: bool = False) -> None:
        if self.sign() != sign:
            raise ExpressionError(f"{sign!r} expected instead of {self.token[1]!r}", self.place)
        self.step(operand_before)

    def many(self, end: str, separator: str, item: Callable) -> list:
        found = []
        while self.sign() != end:
            found.append(item())
            if self.sign() != separator:
                break
            self.step(False)
        self.take(end, True)
        return found

    def whole(self) -> tuple:
        tree = self.expression(0)
        if self.token[0] != "end":
            raise ExpressionError(f"unexpected {self.token[1]!r}", self.place)
        return tree

    def expression(self, power: int) -> tuple:
        left = self.operand()
        while (sign := self.sign()) in BINDS and BINDS[sign] > power:
            if sign == ":=" and left[0] != "variable":
                raise ExpressionError("a value is assigned to something that is no variable", self.place)
            self.step(False)
            if sign == "?":
                then = self.expression(0)
                other = None
                if self.sign() == ":":
                    self.step(False)
                    other = self.expression(BINDS["?"] - 1)
                left = ("if", left, then, other)
            elif sign == "(":
                left = ("call", left, self.many(")", ",", lambda: self.expression(0)))
            elif sign == "[":
                inner = self.expression(0)
                self.take("]", True)
                left = ("at", left, inner)
            elif sign == ".":
                kind, name = self.token
                if kind != "name":
                    raise ExpressionError(f"a path step {name!r} is not supported", self.place)
                self.step(True)
                left = ("field", left, name.strip("`"))
            else:
                left = (sign, left, self.expression(BINDS[sign] - (sign == ":=")))
        if (sign := self.sign()) in ("~>", "**", "..", "^", "@", "#", "|", "{"):
            raise ExpressionError(f"the operator {sign!r} is not supported", self.place)
        return left

    def operand(self) -> tuple:
        (kind, value), place = self.token, self.place
        if kind == "name" and value == "function":
            self.step(True)
            self.take("(")
            names = self.many(")", ",", self.parameter)
            self.take("{")
            body = self.expression(0)
            self.take("}", True)
            return ("function", names, body)
        if kind in ("number", "string", "variable", "name", "regex"):
            self.step(True)
            if kind == "number":
                return ("constant", float(value) if re.search("[.eE]", value) else int(value))
            if kind == "string":
                return ("constant", unescaped(value))
            if kind == "name" and value in ("null", "true", "false"):
                return ("constant", {"null": None, "true": True, "false": False}[value])
            return (kind, value.strip("`") if kind == "name" else value)
        if value == "-":
            self.step(False)
            return ("-", ("constant", 0), self.expression(70))
        if value == "(":
            self.step(False)
            return ("block", self.many(")", ";", lambda: self.expression(0)))
        if value == "[":
            self.step(False)
            return ("array", self.many("]", ",", lambda: self.expression(0)))
        if value == "{":
            self.step(False)
            return ("object", self.many("}", ",", self.member))
        raise ExpressionError("the expression ends too early" if kind == "end" else f"{value!r} is not supported here", place)

    def parameter(self) -> str:
        kind, name = self.token
        if kind != "variable":
            raise ExpressionError(f"a parameter {name!r}", self.place)
        self.step(True)
        return name

    def member(self) -> tuple[str, tuple]:
        kind, name = self.token
        if kind != "string":
            raise ExpressionError("a name in an object that is no plain text", self.place)
        self.step(True)
        self.take(":")
        return unescaped(name), self.expression(0)


@lru_cache(maxsize=1000)
def parsed(source: str) -> tuple:
    return Parser(source).whole()


# Nodes: what a subexpression is.


@dataclass
class Node:
    """``kind`` is string, number, boolean, null, missing, array, object, match, regex or function.  Where ``soft`` holds, a null means missing."""

    kind: str
    col: Column | None = None
    fails: Column | None = None
    soft: bool = False
    item: Node | None = None  # of an array: kind and softness of its elements
    fields: dict[str, Node] = field(default_factory=dict)
    const: Any = None  # value of a constant text or number, pattern of a regular expression, tree of a function
    size: int = 1
    safe: bool = False  # null only where it has failed already, so that it is not looked at again


def nothing(fails: Column | None = None) -> Node:
    return Node("missing", F.lit(None).cast("string"), fails, True)


def broken(*nodes: Node) -> Node:
    """What a function makes of a kind that it does not take: an error wherever it is reached."""
    return nothing(F.lit(True))


def either(*conditions: Column | None) -> Column | None:
    found = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, found) if found else None


def constant(value: Any) -> Node:
    if value is None:
        return Node("null", F.lit(None).cast("string"))
    kind = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
    return Node(kind, F.lit(value) if kind != "number" else F.lit(value).cast("bigint" if isinstance(value, int) else "double"), const=value)


def truth(n: Node) -> Column:
    if n.kind == "boolean":
        return F.coalesce(n.col, F.lit(False))
    if n.kind == "string":
        return F.coalesce(n.col != "", F.lit(False))
    if n.kind == "number":
        return F.coalesce(n.col != 0, F.lit(False))
    if n.kind == "array":
        return F.coalesce(F.exists(n.col, lambda x: truth(replace(n.item, col=x))), F.lit(False)) if n.item.kind in ("string", "number", "boolean") else F.coalesce(F.size(n.col) > 0, F.lit(False))
    if n.kind == "match":
        return n.fields["match"].col.isNotNull()
    return F.lit(n.kind == "object" and bool(n.fields))


def as_text(n: Node) -> Column:
    """The value as a function that makes text shows it: whole numbers without a point, arrays and objects as JSON."""
    if n.kind == "number":
        return F.when((n.col == F.floor(n.col)) & (F.abs(n.col) < 1e15), n.col.cast("bigint").cast("string")).otherwise(n.col.cast("string"))
    return json(n) if n.kind in ("array", "object", "match") else n.col.cast("string")


def json(n: Node) -> Column:
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    if n.kind in ("object", "match"):
        parts, first = [], True
        for name, own in n.fields.items():
            head = quoted(F.lit(name))
            piece = F.concat(head, F.lit(":"), json(own))
            parts.append(F.when(own.col.isNotNull(), piece) if own.soft and own.col is not None else piece)
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    if n.kind == "array":
        return F.concat(F.lit("["), F.array_join(F.transform(n.col, lambda x: json(replace(n.item, col=x))), ","), F.lit("]"))
    shown = quoted(n.col) if n.kind == "string" else as_text(n)
    return F.coalesce(shown, F.lit("null"))


def java(pattern: str, flags: str) -> str:
    """The same regular expression for Spark: $ means the very end."""
    if set(flags) - {"i", "m", "g"}:
        raise ExpressionError(f"the flags {flags!r} of a regular expression are not supported")
    out, inside, k = "", False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out, k = out + pattern[k : k + 2], k + 2
            continue
        inside = c == "[" or inside and c != "]"
        out, k = out + (r"\z" if c == "$" and not inside and "m" not in flags else c), k + 1
    return "".join(f"(?{f})" for f in flags if f in "im") + out


# Functions: each takes compiled arguments.


def _of_text(make: Callable[..., Column], kind: str = "string", safe: bool = True) -> Callable[..., Node]:
    """A function of texts and numbers; fails on nulls and other kinds, passes on what is missing.  ``safe``: never null for a text."""

    def call(*args: Node) -> Node:
        if args[0].kind == "missing":
            return nothing(args[0].fails)
        if args[0].kind != "string":
            return broken()
        col = make(args[0].col, *(a.col if a.const is None else a.const for a in args[1:]))
        null = None if args[0].soft or args[0].safe or args[0].const is not None else args[0].col.isNull()
        return Node(kind, col, either(*(a.fails for a in args), null), args[0].soft, safe=safe and not args[0].soft)

    return call


def _pattern(n: Node) -> str | None:
    return java(*n.const) if n.kind == "regex" else rf"\Q{n.const}\E" if isinstance(n.const, str) else None


def _contains(value: Node, part: Node) -> Node:
    if part.kind == "regex":
        return _of_text(lambda c, _: c.rlike(java(*part.const)), "boolean")(value, part)
    return _of_text(lambda c, p: c.contains(p), "boolean")(value, part) if part.kind == "string" else broken()


def _replace(value: Node, part: Node, new: Node) -> Node:
    if part.kind == "string":
        return _of_text(lambda c, *_: F.replace(c, part.col, new.col))(value, part, new)
    if part.kind != "regex" or not isinstance(new.const, str):
        raise ExpressionError("$replace takes a text or a regular expression, and for the latter a constant text")
    put = re.sub(r"\$\$", r"\\$", new.const.replace("\\", "\\\\"))
    return _of_text(lambda c, *_: F.regexp_replace(c, F.lit(java(*part.const)), F.lit(put)))(value, part, new)


def _split(value: Node, by: Node) -> Node:
    if (pattern := _pattern(by)) is None:
        raise ExpressionError("$split takes a constant text or a regular expression")
    made = _of_text(lambda c, _: F.split(c, pattern, -1), "array")(value, by)
    return replace(made, item=Node("string", soft=True)) if made.kind == "array" else made


def _match(value: Node, by: Node) -> Node:
    if by.kind != "regex":
        raise ExpressionError("$match takes a regular expression")
    pattern = java(*by.const)
    groups = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", by.const[0])).groups
    whole = _of_text(lambda c, _: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 0)), "string", False)(value, by)
    if whole.kind == "missing":
        return whole
    soft = replace(whole, soft=True)
    found = F.array(*(F.regexp_extract(value.col, pattern, k) for k in range(1, groups + 1))).cast("array<string>")
    begin = F.instr(value.col, whole.col) - 1 if not re.search(r"[\^$]|\\b|\(\?", by.const[0]) else F.when(F.lit(by.const[0].startswith("^")), F.lit(0)).otherwise(F.instr(value.col, whole.col) - 1)
    return Node("match", whole.col, whole.fails, True, fields={"match": soft, "index": Node("number", F.when(whole.col.isNotNull(), begin).cast("bigint"), soft=True), "groups": Node("array", F.when(whole.col.isNotNull(), found), soft=True, item=Node("string", soft=True))})


def _number(value: Node) -> Node:
    if value.kind in ("number", "missing"):
        return value
    if value.kind == "boolean":
        return Node("number", value.col.cast("bigint"), value.fails, value.soft)
    if value.kind != "string":
        return broken()
    number = F.when(value.col.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$"), value.col.try_cast("double"))
    bad = number.isNull() & value.col.isNotNull() if value.soft else number.isNull()
    return Node("number", number, either(value.fails, bad), value.soft, safe=not value.soft)


def _of_number(make: Callable[[Column], Column]) -> Callable[[Node], Node]:
    def call(value: Node) -> Node:
        if value.kind == "missing":
            return value
        if value.kind != "number":
            return broken()
        return replace(value, col=make(value.col), const=None, fails=either(value.fails, None if value.soft or value.safe else value.col.isNull()), safe=not value.soft)

    return call


def _substring(value: Node, start: Node, length: Node | None = None) -> Node:
    def make(c: Column, *_: Any) -> Column:
        first = F.when(start.col < 0, F.greatest(F.length(c) + start.col, F.lit(0))).otherwise(start.col).cast("int") + 1
        return F.substr(c, first, F.length(c) if length is None else F.greatest(length.col, F.lit(0)).cast("int"))

    return _of_text(make)(value)


def _type(value: Node) -> Node:
    if value.kind == "missing":
        return value
    kind = "array" if value.kind == "match" else value.kind
    return Node("string", F.when(value.col.isNull(), F.lit(None if value.soft else "null")).otherwise(kind) if value.kind not in ("null", "object") else F.lit(kind), value.fails, value.soft)


def _count(value: Node) -> Node:
    if value.kind == "array":
        return Node("number", F.coalesce(F.size(value.col), F.lit(0)).cast("bigint"), value.fails)
    return Node("number", truth(Node("boolean", value.col.isNotNull())).cast("bigint") if value.kind != "object" else F.lit(1), value.fails)


def _join(value: Node, by: Node | None = None) -> Node:
    if value.kind != "array" or value.item.kind != "string":
        return value if value.kind in ("missing", "string") else broken()
    return Node("string", F.array_join(value.col, by.const if by is not None else ""), value.fails, value.soft)


def _lookup(value: Node, key: Node) -> Node:
    if value.kind != "object" or key.kind != "string":
        return broken() if value.kind != "missing" else value
    if isinstance(key.const, str):
        return value.fields.get(key.const, nothing())
    kinds = {n.kind for n in value.fields.values()}
    if len(kinds) != 1 or not kinds <= {"string", "number", "boolean"}:
        raise ExpressionError("$lookup takes an object whose values are of one kind")
    table = F.create_map(*(x for name, n in value.fields.items() for x in (F.lit(name), n.col)))
    return Node(kinds.pop(), F.try_element_at(table, key.col), either(key.fails, *(n.fails for n in value.fields.values())), True)


def _case(value: Node, style: Node) -> Node:
    if not isinstance(style.const, str):
        raise ExpressionError("$normalize_case takes a constant style")
    return _of_text(lambda c, s: text.normalize_case(c, s))(value, style)


def _first_filled(*args: Node) -> Node:
    kinds = {a.kind for a in args} - {"missing", "null"}
    if len(kinds) > 1:
        raise ExpressionError("$coalesce takes values of one kind")
    cols = [V.filled(a.col) if a.kind == "string" else a.col for a in args if a.kind not in ("missing", "null")]
    return Node(kinds.pop(), F.coalesce(*cols), either(*(a.fails for a in args))) if cols else constant(None)


def _constants(make: Callable[..., Column], kind: str = "string") -> Callable[..., Node]:
    """A function of a text whose other arguments must be constants."""

    def call(value: Node, *rest: Node) -> Node:
        if any(r.const is None for r in rest):
            raise ExpressionError("the arguments behind the first must be constants")
        return _of_text(lambda c, *_: make(c, *(r.const for r in rest)), kind)(value)

    return call


def _similar(a: Node, b: Node) -> Node:
    return Node("number", similarity.similarity(a.col.cast("string"), b.col.cast("string")), either(a.fails, b.fails))


FUNCTIONS: dict[str, Callable[..., Node]] = {
    "lowercase": _of_text(F.lower), "uppercase": _of_text(F.upper), "length": _of_text(lambda c: F.length(c).cast("bigint"), "number"),
    "trim": _of_text(lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))), "contains": _contains, "replace": _replace, "split": _split, "match": _match,
    "substring": _substring, "substringBefore": _constants(lambda c, s: F.when(c.contains(s), F.substring_index(c, s, 1)).otherwise(c)),
    "substringAfter": _constants(lambda c, s: F.when(c.contains(s), F.substr(c, F.instr(c, s) + len(s))).otherwise(c)), "join": _join,
    "number": _number, "floor": _of_number(lambda c: F.floor(c)), "ceil": _of_number(lambda c: F.ceil(c)), "abs": _of_number(F.abs), "round": _of_number(lambda c: F.bround(c)),
    "string": lambda n: n if n.kind == "missing" else Node("string", F.coalesce(as_text(n), F.lit(None if n.soft else "null")), n.fails, n.soft),
    "not": lambda n: n if n.kind == "missing" else Node("boolean", ~truth(n), n.fails), "boolean": lambda n: n if n.kind == "missing" else Node("boolean", truth(n), n.fails),
    "exists": lambda n: Node("boolean", F.lit(n.kind != "missing") if not n.soft or n.kind == "missing" else n.col.isNotNull(), n.fails),
    "type": _type, "count": _count, "lookup": _lookup, "coalesce": _first_filled, "similarity": _similar, "normalize_case": _case,
    "clean_whitespace": _of_text(text.clean_whitespace), "parse_number": _of_text(text.parse_number, "number", False), "extract_domain": _of_text(text.extract_domain, "string", False),
    "format_phone": _constants(lambda c, region="US": phone.format_phone(c, region)), "parse_date": _constants(lambda c, style="iso": text.parse_date(c, style)),
}


class Compiler:
    def __init__(self, bound: dict[str, Node], record: Callable[[str], Node]):
        self.bound, self.record, self.size = bound, record, 0

    def __call__(self, tree: tuple, scope: dict[str, Node]) -> Node:
        self.size += 1
        return getattr(self, "_" + {"+": "arithmetic", "-": "arithmetic", "*": "arithmetic", "/": "arithmetic", "%": "arithmetic", "=": "compare", "!=": "compare", "<": "compare", ">": "compare", "<=": "compare", ">=": "compare", "&": "concat", "and": "logic", "or": "logic", "in": "member", "if": "choice", ":=": "assign"}.get(tree[0], tree[0]))(tree, scope)

    def _constant(self, tree: tuple, scope: dict) -> Node:
        return constant(tree[1])

    def _regex(self, tree: tuple, scope: dict) -> Node:
        return Node("regex", const=tree[1])

    def _function(self, tree: tuple, scope: dict) -> Node:
        return Node("function", const=(tree, scope))

    def _variable(self, tree: tuple, scope: dict) -> Node:
        if tree[1] in ("$", "$$"):
            raise ExpressionError(f"{tree[1]} for the input is not supported; use value")
        found = scope.get(tree[1], nothing())
        self.size += found.size
        if self.size > MOST:
            raise ExpressionError(f"the expression unfolds to more than {MOST} operations")
        return found

    def _name(self, tree: tuple, scope: dict) -> Node:
        return self.bound.get(tree[1], nothing()) if tree[1] != "record" else Node("record")

    def _field(self, tree: tuple, scope: dict) -> Node:
        base = self(tree[1], scope)
        if base.kind == "record":
            return self.record(tree[2])
        own = base.fields.get(tree[2]) if base.kind in ("object", "match") else None
        return replace(own, fails=either(base.fails, own.fails)) if own is not None else nothing(base.fails)

    def _at(self, tree: tuple, scope: dict) -> Node:
        base, index = self(tree[1], scope), self(tree[2], scope)
        if base.kind == "missing" or index.kind != "number":
            if base.kind != "missing":
                raise ExpressionError("a filter in brackets that is no number is not supported")
            return base
        at = index.col.cast("int")
        if base.kind != "array":  # a single value is a sequence of one
            return replace(base, col=F.when(at.isin(0, -1), base.col), soft=True, safe=False, const=None) if base.col is not None else base
        return replace(base.item, col=F.get(base.col, F.when(at < 0, F.size(base.col) + at).otherwise(at)), fails=either(base.fails, index.fails), soft=True)

    def _block(self, tree: tuple, scope: dict) -> Node:
        scope, last = dict(scope), nothing()
        for part in tree[1]:
            last = self(part, scope)
        return last

    def _assign(self, tree: tuple, scope: dict) -> Node:
        before = self.size
        scope[tree[1][1]] = made = self(tree[2], scope)
        made.size = max(1, self.size - before)
        return made

    def _array(self, tree: tuple, scope: dict) -> Node:
        items = [self(t, scope) for t in tree[1]]
        kinds = {n.kind for n in items}
        if len(kinds) > 1 or not kinds <= {"string", "number", "boolean"}:
            raise ExpressionError("an array of several kinds, or of arrays or objects, is not supported")
        item = replace(items[0], const=None, soft=False) if items else Node("string")
        return Node("array", F.array(*(n.col for n in items)) if items else F.array().cast("array<string>"), either(*(n.fails for n in items)), item=item)

    def _object(self, tree: tuple, scope: dict) -> Node:
        fields = {name: self(t, scope) for name, t in tree[1]}
        return Node("object", F.lit(True), either(*(n.fails for n in fields.values())), fields=fields)

    def _choice(self, tree: tuple, scope: dict) -> Node:
        test = self(tree[1], scope)
        then, other = self(tree[2], dict(scope)), self(tree[3], dict(scope)) if tree[3] is not None else nothing()
        when = truth(test)
        fails = either(test.fails, when & then.fails if then.fails is not None else None, ~when & other.fails if other.fails is not None else None)
        return replace(self._merged(when, then, other), fails=fails, const=None)

    def _merged(self, when: Column, a: Node, b: Node) -> Node:
        if a.kind in ("null", "missing") and b.kind in ("null", "missing"):
            return Node("null", F.lit(None).cast("string"), soft=a.kind == b.kind == "missing")
        if a.kind in ("null", "missing") or b.kind in ("null", "missing"):
            some, empty = (b, a) if a.kind in ("null", "missing") else (a, b)
            kept = some if some.kind not in ("object", "match") else Node("json", json(some))
            return replace(kept, col=F.when(~when if some is b else when, kept.col), soft=kept.soft and empty.kind == "missing", safe=False)
        if a.kind == b.kind == "object" and list(a.fields) == list(b.fields) and all(x.kind == y.kind and x.kind in ("string", "number", "boolean") for x, y in zip(a.fields.values(), b.fields.values())):
            return Node("object", F.lit(True), fields={k: self._merged(when, x, b.fields[k]) for k, x in a.fields.items()})
        if a.kind == b.kind and a.kind in ("string", "number", "boolean", "array", "json"):
            return replace(a, col=F.when(when, a.col).otherwise(b.col), soft=a.soft and b.soft, safe=a.safe and b.safe)
        return Node("json", F.when(when, json(a) if a.kind != "json" else a.col).otherwise(json(b) if b.kind != "json" else b.col))

    def _logic(self, tree: tuple, scope: dict) -> Node:
        a, b = self(tree[1], scope), self(tree[2], scope)
        left, right = truth(a), truth(b)
        reached = left if tree[0] == "and" else ~left  # the second side is looked at only where it decides
        return Node("boolean", left & right if tree[0] == "and" else left | right, either(a.fails, reached & b.fails if b.fails is not None else None))

    def _compare(self, tree: tuple, scope: dict) -> Node:
        sign, a, b = tree[0], self(tree[1], scope), self(tree[2], scope)
        fails = either(a.fails, b.fails)
        if "missing" in (a.kind, b.kind):
            return Node("boolean", F.lit(False), fails)
        soft = [n.col.isNull() for n in (a, b) if n.soft]
        lost = either(*soft) if soft else F.lit(False)
        if sign in ("=", "!="):
            if "null" in (a.kind, b.kind):
                same = a.col.isNull() & b.col.isNull() if a.kind not in ("object",) and b.kind not in ("object",) else F.lit(False)
            elif a.kind != b.kind:
                same = F.lit(False)
            elif a.kind in ("string", "number", "boolean", "array"):
                same = a.col.eqNullSafe(b.col)
            else:
                same = json(a).eqNullSafe(json(b))
            return Node("boolean", ~lost & (same if sign == "=" else ~same), fails)
        if a.kind != b.kind or a.kind not in ("string", "number"):
            return broken()
        held = {"<": a.col < b.col, ">": a.col > b.col, "<=": a.col <= b.col, ">=": a.col >= b.col}[sign]
        hard = either(*(n.col.isNull() for n in (a, b) if not n.soft and not n.safe and n.const is None))
        return Node("boolean", F.coalesce(held, F.lit(False)), either(fails, hard))

    def _arithmetic(self, tree: tuple, scope: dict) -> Node:
        a, b = self(tree[1], scope), self(tree[2], scope)
        if "missing" in (a.kind, b.kind):
            return nothing(either(a.fails, b.fails))
        if a.kind != "number" or b.kind != "number":
            return broken()
        made = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "/": lambda: F.try_divide(a.col.cast("double"), b.col), "%": lambda: F.try_mod(a.col, b.col)}[tree[0]]()
        hard = either(*(n.col.isNull() for n in (a, b) if not n.soft and not n.safe and n.const is None), (b.col == 0) if tree[0] in "/%" and not b.const else None)
        return Node("number", made, either(a.fails, b.fails, hard), a.soft or b.soft, const=-b.const if tree[0] == "-" and a.const == 0 and b.const is not None else None)

    def _concat(self, tree: tuple, scope: dict) -> Node:
        a, b = self(tree[1], scope), self(tree[2], scope)
        shown = [F.coalesce(as_text(n) if n.kind not in ("missing", "json") else n.col, F.lit("" if n.soft else "null")) for n in (a, b)]
        const = a.const + b.const if isinstance(a.const, str) and isinstance(b.const, str) else None
        return Node("string", F.concat(*shown), either(a.fails, b.fails), const=const)

    def _member(self, tree: tuple, scope: dict) -> Node:
        a, b = self(tree[1], scope), self(tree[2], scope)
        if "missing" in (a.kind, b.kind):
            return Node("boolean", F.lit(False), either(a.fails, b.fails))
        inside = F.array_contains(b.col, a.col) if b.kind == "array" and b.item.kind == a.kind else a.col == b.col if a.kind == b.kind else F.lit(False)
        return Node("boolean", F.coalesce(F.when(a.col.isNotNull(), inside), F.lit(False)), either(a.fails, b.fails))

    def _call(self, tree: tuple, scope: dict) -> Node:
        if tree[1][0] != "variable":
            raise ExpressionError("a call of something that is no function")
        name = tree[1][1][1:]
        if name in ("record", "source", "meta") and not tree[2]:
            return self._name(("name", name), scope)
        args = [self(t, scope) for t in tree[2]]
        if name == "map":
            return self._map(*args)
        if name not in FUNCTIONS:
            raise ExpressionError(f"the function ${name} is not supported")
        try:
            return FUNCTIONS[name](*args)
        except TypeError as x:
            raise ExpressionError(f"${name} does not take {len(args)} arguments") from x

    def _map(self, value: Node, function: Node) -> Node:
        if function.kind != "function":
            raise ExpressionError("$map takes a function in place")
        (_, names, body), scope = function.const
        if value.kind != "array":
            value = Node("array", F.array(value.col), value.fails, item=value) if value.kind in ("string", "number", "boolean") else value
        if value.kind != "array":
            return value if value.kind == "missing" else broken()
        seen: list[Node] = []

        def each(x: Column, i: Column) -> Column:
            own = dict(zip(names, (replace(value.item, col=x, soft=False), Node("number", i.cast("bigint")))))
            made = self(body, {**scope, **own})
            seen.append(made)
            return made.col

        col = F.transform(value.col, each)
        if seen[-1].kind not in ("string", "number", "boolean"):
            raise ExpressionError("$map with a function that makes arrays or objects is not supported")
        wrong = F.exists(F.transform(value.col, lambda x, i: self._fails(each, seen, x, i)), lambda f: f) if seen[-1].fails is not None else None
        return Node("array", F.filter(col, lambda x: x.isNotNull()) if seen[-1].soft else col, either(value.fails, wrong), value.soft, item=Node(seen[-1].kind))

    @staticmethod
    def _fails(each: Callable, seen: list[Node], x: Column, i: Column) -> Column:
        each(x, i)
        return F.coalesce(seen[-1].fails, F.lit(False))


def compiled(source: str, value: Column, kind: str = "string", record: Callable[[str], Column] | None = None, origin: Column | None = None, meta: dict[str, Any] | None = None) -> Node:
    """The expression over ``value``; ``record`` gives the columns of the record by name (as text), ``origin`` is bound as source, ``meta`` holds constants."""
    bound = {"value": Node(kind, value), "source": Node("string", origin) if origin is not None else nothing(), "meta": Node("object", F.lit(True), fields={k: constant(v) for k, v in (meta or {}).items()})}
    fetch = record or F.col
    return Compiler(bound, lambda name: Node("string", fetch(name).cast("string")))(parsed(source.strip()), {})


def result(n: Node) -> Column:
    """The value as text, objects and arrays as JSON; null where it is null or missing."""
    if n.kind == "object":
        return json(n)
    if n.kind in ("array", "match"):
        return F.when(n.col.isNotNull(), json(n))
    return as_text(n) if n.kind != "json" else n.col


def condition(n: Node) -> Column:
    """Whether a result counts as true."""
    return truth(n) if n.kind != "json" else n.col.isNotNull()
