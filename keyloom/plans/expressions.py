"""The table expression language: conditions, projections, key conditions and updates, compiled to Columns.

Text is cut into tokens, parsed into small trees and turned into Column expressions, so that Catalyst
sees ordinary predicates: pushed to the scan, folded and pruned. Values come in as parameters (`:v`)
and names may be placeholders (`#n`); nothing is ever spliced into SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

_TOKEN = re.compile(r"\s*(?:(<>|<=|>=|[=<>(),+\-\[\].])|([#:]?[A-Za-z0-9_][A-Za-z0-9_\-]*|[#:][A-Za-z0-9_\-]+))")
COMPARISONS = {"=", "<>", "<", "<=", ">", ">="}
FUNCTIONS = {"attribute_exists", "attribute_not_exists", "attribute_type", "begins_with", "contains"}


class ExpressionError(ValueError):
    """A text that isn't in the language, or that names a parameter which isn't given."""


@dataclass(frozen=True)
class Path:
    """A document path: names and list positions from the top-level attribute down."""

    parts: tuple


@dataclass(frozen=True)
class Value:
    value: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


class _Tokens:
    def __init__(self, text: str, names: dict[str, str], values: dict[str, Any]) -> None:
        self.items: list[str] = []
        self.at, at = 0, 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at:at + 10]!r}")
            self.items.append(m[1] or m[2])
            at = m.end()
        self.names, self.values = names or {}, values or {}

    def peek(self, ahead: int = 0) -> str:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or (wanted and token.upper() not in wanted):
            raise ExpressionError(f"expected {' or '.join(wanted) or 'more'}, found {token or 'the end'!r}")
        self.at += 1
        return token

    def word(self, word: str) -> bool:
        if self.peek().upper() == word:
            self.at += 1
            return True
        return False

    def end(self) -> None:
        if self.at < len(self.items):
            raise ExpressionError(f"unexpected {self.peek()!r}")

    def path(self) -> Path:
        parts: list = [self._name()]
        while self.peek() in (".", "["):
            if self.take() == ".":
                parts.append(self._name())
            else:
                parts.append(int(self.take()))
                self.take("]")
        return Path(tuple(parts))

    def _name(self) -> str:
        token = self.take()
        if token.startswith("#"):
            if token not in self.names:
                raise ExpressionError(f"no name for {token}")
            return self.names[token]
        if not re.match(r"[A-Za-z0-9_]", token):
            raise ExpressionError(f"expected a name, found {token!r}")
        return token

    def operand(self):
        token = self.peek()
        if token.startswith(":"):
            self.take()
            if token not in self.values:
                raise ExpressionError(f"no value for {token}")
            return Value(self.values[token])
        if self.peek(1) == "(":
            name = self.take().lower()
            self.take("(")
            args = [self.operand()]
            while self.word(","):
                args.append(self.operand())
            self.take(")")
            return Call(name, tuple(args))
        return self.path()


def _condition(t: _Tokens):
    """OR binds least, then AND, then NOT."""
    left = _conjunction(t)
    while t.word("OR"):
        left = ("or", left, _conjunction(t))
    return left


def _conjunction(t: _Tokens):
    left = _negation(t)
    while t.word("AND"):
        left = ("and", left, _negation(t))
    return left


def _negation(t: _Tokens):
    if t.word("NOT"):
        return ("not", _negation(t))
    if t.peek() == "(":
        t.take("(")
        inner = _condition(t)
        t.take(")")
        return inner
    left = t.operand()
    if isinstance(left, Call) and left.name in FUNCTIONS:
        return ("call", left)
    if t.word("BETWEEN"):
        low = t.operand()
        t.take("AND")
        return ("between", left, low, t.operand())
    if t.word("IN"):
        t.take("(")
        options = [t.operand()]
        while t.word(","):
            options.append(t.operand())
        t.take(")")
        return ("in", left, options)
    return ("compare", t.take(*COMPARISONS), left, t.operand())


def literal(value: Any) -> Column:
    if isinstance(value, (set, frozenset)):
        return F.array(*[F.lit(v) for v in sorted(value)])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


def column_of(path: Path) -> Column:
    column = F.col(f"`{path.parts[0]}`")
    for part in path.parts[1:]:
        column = F.get(column, part) if isinstance(part, int) else column.getField(part)
    return column


_TYPES = {"S": ("string",), "N": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "B": ("binary",), "BOOL": ("boolean",), "L": ("array",), "M": ("map", "struct")}


@dataclass
class Compiler:
    """missing: what a comparison with an absent operand gives. 'strict': false. 'lenient': true for =, <= and >=."""

    missing: str = "strict"
    types: dict[str, str] | None = None

    def size(self, x) -> Column:
        """Elements of a collection, else bytes (not characters)."""
        kind = (self.types or {}).get(x.parts[0], "") if isinstance(x, Path) and len(x.parts) == 1 else ""
        return F.size(self.operand(x)) if kind.startswith(("array", "map")) else F.octet_length(self.operand(x))

    def operand(self, x) -> Column:
        if isinstance(x, Value):
            return literal(x.value)
        if isinstance(x, Path):
            return column_of(x)
        if x.name == "size":
            return self.size(x.args[0])
        raise ExpressionError(f"no operand: {x.name}")

    def condition(self, tree) -> Column:
        kind = tree[0]
        if kind in ("and", "or"):
            a, b = self.condition(tree[1]), self.condition(tree[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.condition(tree[1])
        false = F.lit(False)
        if kind == "compare":
            _, op, x, y = tree
            a, b = self.operand(x), self.operand(y)
            if isinstance(y, Value) and isinstance(y.value, (set, frozenset)):
                a, b = F.array_sort(a), F.array_sort(b)
            met = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            return F.coalesce(met, F.lit(self.missing == "lenient" and op in ("=", "<=", ">=")))
        if kind == "between":
            return F.coalesce(self.operand(tree[1]).between(self.operand(tree[2]), self.operand(tree[3])), false)
        if kind == "in":
            return F.coalesce(self.operand(tree[1]).isin(*[self.operand(o) for o in tree[2]]), false)
        return F.coalesce(self.call(tree[1]), false)

    def call(self, call: Call) -> Column:
        path = self.operand(call.args[0])
        if call.name == "attribute_exists":
            return path.isNotNull()
        if call.name == "attribute_not_exists":
            return path.isNull()
        if call.name == "attribute_type":
            wanted = call.args[1].value
            kinds = _TYPES.get(wanted)
            if kinds is None:
                raise ExpressionError(f"no type {wanted}")
            starts = [F.startswith(F.typeof(path), F.lit(k)) for k in kinds]
            met = starts[0]
            for s in starts[1:]:
                met = met | s
            return path.isNotNull() & met
        argument = self.operand(call.args[1])
        if call.name == "begins_with":
            return F.startswith(path, argument)
        kind = (self.types or {}).get(call.args[0].parts[0], "") if isinstance(call.args[0], Path) else ""
        value = call.args[1].value if isinstance(call.args[1], Value) else None
        part = isinstance(value, (str, bytes)) and not kind.startswith("array")
        return F.contains(path, argument) if part else F.array_contains(path, argument)


def contains_element(path: str, value: Any) -> Column:
    """Membership in a list or set attribute."""
    return F.coalesce(F.array_contains(F.col(path), literal(value)), F.lit(False))


def condition(text: str, names: dict[str, str] | None = None, values: dict[str, Any] | None = None, missing: str = "strict", types: dict[str, str] | None = None) -> Column:
    """A filter or write condition as one boolean Column that is never null. types: dict(df.dtypes), for size() of collections."""
    t = _Tokens(text, names or {}, values or {})
    tree = _condition(t)
    t.end()
    return Compiler(missing, types).condition(tree)


def projection(text: str | None, names: dict[str, str] | None = None) -> list[str] | None:
    """Top-level attribute names; None for all."""
    if not text or not text.strip():
        return None
    out = []
    for part in text.split(","):
        name = part.strip()
        name = (names or {}).get(name, name)
        if not name:
            raise ExpressionError("empty name in a projection")
        if name not in out:
            out.append(name)
    return out


@dataclass
class KeyCondition:
    """hash value, and the range term: operator and its operands."""

    hash_value: Any
    op: str | None = None
    low: Any = None
    high: Any = None

    def column(self, hash_key: str, range_key: str | None) -> Column:
        met = F.col(hash_key) == F.lit(self.hash_value)
        if self.op is None:
            return met
        c, low = F.col(range_key), F.lit(self.low)
        terms = {"=": c == low, "<": c < low, "<=": c <= low, ">": c > low, ">=": c >= low}
        if self.op == "between":
            return met & c.between(low, F.lit(self.high))
        if self.op == "begins_with":
            return met & F.startswith(c, low)
        return met & terms[self.op]


def key_condition(text: str, hash_key: str, range_key: str | None = None, names: dict[str, str] | None = None, values: dict[str, Any] | None = None) -> KeyCondition:
    """One equality on the hash key and at most one term on the range key, joined by AND."""
    t = _Tokens(text, names or {}, values or {})
    terms = [_negation(t)]
    while t.word("AND"):
        terms.append(_negation(t))
    t.end()
    found: KeyCondition | None = None
    rest = []
    for term in terms:
        if term[0] == "compare" and term[1] == "=" and term[2] == Path((hash_key,)) and isinstance(term[3], Value) and found is None:
            found = KeyCondition(term[3].value)
        else:
            rest.append(term)
    if found is None or len(rest) > 1:
        raise ExpressionError("a key condition has one equality on the hash key and at most one range term")
    for term in rest:
        key = term[1].args[0] if term[0] == "call" else term[2] if term[0] == "compare" else term[1]
        if range_key is None or key != Path((range_key,)):
            raise ExpressionError(f"no range key: {key}")
        if term[0] == "between":
            found.op, found.low, found.high = "between", term[2].value, term[3].value
        elif term[0] == "call" and term[1].name == "begins_with":
            found.op, found.low = "begins_with", term[1].args[1].value
        elif term[0] == "compare" and term[1] != "<>":
            found.op, found.low = term[1], term[3].value
        else:
            raise ExpressionError("not a range term")
    return found


def update(text: str, names: dict[str, str] | None = None, values: dict[str, Any] | None = None, types: dict[str, str] | None = None) -> dict[str, Column | None]:
    """Sections SET, REMOVE, ADD and DELETE, each at most once, as new columns by top-level name; None removes.

    types: simple type names of the columns (DataFrame.dtypes), for ADD and DELETE on arrays.
    """
    t = _Tokens(text, names or {}, values or {})
    out: dict[str, Column | None] = {}
    seen: set[str] = set()
    compiler = Compiler()

    def term() -> Column:
        x = t.operand()
        if isinstance(x, Call) and x.name == "if_not_exists":
            return F.coalesce(compiler.operand(x.args[0]), compiler.operand(x.args[1]))
        if isinstance(x, Call) and x.name == "list_append":
            return F.concat(*[compiler.operand(a) for a in x.args])
        return compiler.operand(x)

    def sum_of() -> Column:  # the first operator splits: a - b - c is a - (b - c)
        left = term()
        if t.word("+"):
            return left + sum_of()
        if t.word("-"):
            return left - sum_of()
        return left

    while t.peek():
        section = t.take("SET", "REMOVE", "ADD", "DELETE").upper()
        if section in seen:
            raise ExpressionError(f"{section} occurs twice")
        seen.add(section)
        while True:
            path = t.path()
            name, inner = path.parts[0], path.parts[1:]
            current = out.get(name, F.col(f"`{name}`"))
            if section == "SET":
                t.take("=")
                kind = (types or {}).get(name)
                out[name] = _assign(current, inner, sum_of(), DataType.fromDDL(kind) if inner and kind else None)
            elif section == "REMOVE":
                out[name] = _remove(current, inner) if inner else None
            else:
                operand = t.operand() if section == "ADD" or t.peek().startswith(":") else None
                if operand is None:
                    out[name] = None
                elif (types or {}).get(name, "").startswith("array") or isinstance(operand.value, (set, frozenset, list)):
                    new = literal(operand.value)
                    if section == "ADD":
                        out[name] = F.coalesce(F.array_union(current, new), new)
                    else:
                        left = F.array_except(current, new)
                        out[name] = F.when(F.size(left) > 0, left)
                else:
                    out[name] = F.coalesce(current, F.lit(0)) + literal(operand.value)
            if not t.word(","):
                break
    return out


def _assign(column: Column, inner: tuple, value: Column, kind: DataType | None = None) -> Column:
    """The column with what is at the inner path replaced. A list position beyond the end appends; with its type (kind)
    known, a container that is null is made."""
    if not inner:
        return value
    head, rest = inner[0], inner[1:]
    if isinstance(head, int):
        below = kind.elementType if isinstance(kind, ArrayType) else None
        new = _assign(F.get(column, head), rest, value, below)
        whole = column if below is None else F.coalesce(column, F.array().cast(kind))
        new = new if below is None else new.cast(below)
        return F.when(F.size(whole) <= head, F.array_append(whole, new)).otherwise(F.transform(whole, lambda x, i: F.when(i == head, new).otherwise(x)))
    below = next((f.dataType for f in kind.fields if f.name == head), None) if isinstance(kind, StructType) else None
    whole = F.coalesce(column, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])) if isinstance(kind, StructType) else column
    return whole.withField(head, _assign(column.getField(head), rest, value, below))


def _remove(column: Column, inner: tuple) -> Column:
    head, rest = inner[0], inner[1:]
    if rest:
        return _assign(column, (head,), _remove(F.get(column, head) if isinstance(head, int) else column.getField(head), rest))
    if isinstance(head, int):
        return F.filter(column, lambda x, i: i != head)
    return column.dropFields(head)


def canonical_number(text: str) -> str:
    """Decimal text without exponent, plus sign or needless zeros."""
    d = Decimal(text)
    if not d.is_finite():
        raise ExpressionError(f"no number: {text}")
    s = format(d, "f")
    s = s.rstrip("0").rstrip(".") if "." in s else s
    return "0" if s in ("-0", "") else s
