"""Compile expressions to columns.

Every compiled value knows its kind (int, real, string, bool, list, variant, null or any), which decides integer
division and identity.  A variant holds values of several types: it is a number, a string or a condition where one is
asked for and it holds that, else undefined.  A string compared with a number counts as the number that it spells.  Undefined is NULL; an error, such as a division by zero, is NULL as well.  A name that no column has is
undefined.  Names are matched without regard to case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as N
from ..plans.lexer import QueryError


@dataclass
class Value:
    column: Column
    kind: str
    time: Column | None = None  # the timestamp behind whole seconds, which counts in comparisons


UNDEFINED = "null"


def kind_of(data_type: T.DataType) -> str:
    match data_type:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "int"
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return "real"
        case T.StringType():
            return "string"
        case T.BooleanType():
            return "bool"
        case T.ArrayType():
            return "list"
        case T.VariantType():
            return "variant"
        case T.NullType():
            return UNDEFINED
    return "any"


Resolver = Callable[[N.Ref], Value]


def resolver(df: DataFrame, prefix: str = "") -> Resolver:
    """Look names up among a frame's columns; `prefix` is an alias to qualify them with."""
    found = {f.name.lower(): f for f in df.schema.fields}

    def look(ref: N.Ref) -> Value:
        f = found.get(ref.name.lower())
        if f is None:
            return Value(F.lit(None), UNDEFINED)
        column = F.col(f"{prefix}`{f.name}`")
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):  # the dialect's times are seconds
            return Value(F.unix_timestamp(column.cast("timestamp")), "int", column if isinstance(f.dataType, T.TimestampType) else column.cast("timestamp_ntz"))
        return Value(column, kind_of(f.dataType))

    return look


def two_sided(mine: Resolver, target: Resolver) -> Resolver:
    """MY and TARGET scopes; a bare name is looked up on the own side first."""

    def look(ref: N.Ref) -> Value:
        if ref.scope != "TARGET":
            got = mine(ref)
            if ref.scope == "MY" or got.kind != UNDEFINED:
                return got
        return target(ref)

    return look


def _strcat(args: list[Value]) -> Value:
    return Value(F.concat(*[key_of(a).cast("string") for a in args]), "string")


def _member(args: list[Value]) -> Value:
    return Value(F.array_contains(args[1].column, args[0].column), "bool")


def _same(kind: str | None, make: Callable[..., Column]) -> Callable[[list[Value]], Value]:
    return lambda args: Value(make(*[a.column for a in args]), kind or args[0].kind)


FUNCTIONS: dict[str, tuple[int, Callable[[list[Value]], Value]]] = {  # least number of arguments
    "strcat": (1, _strcat),
    "string": (1, _same("string", lambda x: x.cast("string"))),
    "int": (1, _same("int", lambda x: x.try_cast("double").cast("long"))),
    "real": (1, _same("real", lambda x: x.try_cast("double"))),
    "member": (2, _member),
    "size": (1, lambda a: Value(F.size(a[0].column) if a[0].kind == "list" else F.length(a[0].column), "int")),
    "regexp": (2, _same("bool", lambda p, s: F.regexp_like(s, p))),
    "isundefined": (1, _same("bool", lambda x: x.isNull())),
    "ifthenelse": (3, lambda a: _choice(a[0], a[1], a[2])),
    "toupper": (1, _same("string", F.upper)),
    "tolower": (1, _same("string", F.lower)),
    "substr": (2, _same("string", lambda s, at, n=None: F.substring(s, at + 1, n) if n is not None else F.substring(s, at + 1, F.length(s)))),
    "floor": (1, _same("int", F.floor)),
    "ceiling": (1, _same("int", F.ceil)),
    "round": (1, _same("int", lambda x: F.round(x).cast("long"))),
    "abs": (1, _same(None, F.abs)),
    "min": (1, _same(None, F.array_min)),
    "max": (1, _same(None, F.array_max)),
    "time": (0, lambda a: Value(F.unix_timestamp(), "int")),
}


def _choice(c: Value, a: Value, b: Value) -> Value:
    return Value(F.when(c.column.isNull(), None).when(c.column, a.column).otherwise(b.column), common(a, b))


def common(*values: Value) -> str:
    """The kind that holds all of the values."""
    kinds = {v.kind for v in values} - {UNDEFINED}
    if kinds <= {"int", "real"} and len(kinds) == 2:
        return "real"
    return kinds.pop() if len(kinds) == 1 else "variant" if kinds and "any" not in kinds else "any" if kinds else UNDEFINED


def as_kind(v: Value, kind: str) -> Value:
    """A variant's values of one kind, the others undefined; other values as they are."""
    if v.kind != "variant" or kind in ("variant", "any", UNDEFINED, "list"):
        return v
    held = F.schema_of_variant(v.column)
    number = ~held.isin("STRING", "BOOLEAN", "VOID") & ~held.startswith("ARRAY") & ~held.startswith("OBJECT")
    fits = {"string": held == "STRING", "bool": held == "BOOLEAN"}.get(kind, number)
    kind = "real" if kind == "int" else kind
    return Value(F.when(fits, F.try_variant_get(v.column, "$", {"string": "string", "bool": "boolean"}.get(kind, "double"))), kind)


def key_of(v: Value) -> Column:
    """A column to group, sort or tell apart by: a variant's text, since its values have no order."""
    return F.try_variant_get(v.column, "$", "string") if v.kind == "variant" else v.column


class Compiler:
    """Compiles against a resolver.  `extra` answers nodes that are columns already, such as aggregates.

    `fold_case` makes == and != on strings ignore case.
    """

    def __init__(self, look: Resolver, extra: Callable[[N.Node], Value | None] = lambda n: None, fold_case: bool = False):
        self.look, self.extra, self.fold_case = look, extra, fold_case

    def column(self, node: N.Node) -> Column:
        return self.value(node).column

    def condition(self, node: N.Node) -> Column:
        v = as_kind(self.value(node), "bool")
        if v.kind in ("int", "real"):
            return v.column != 0
        return v.column if v.kind == "bool" else v.column.try_cast("boolean")

    def value(self, node: N.Node) -> Value:
        got = self.extra(node)
        if got is not None:
            return got
        match node:
            case N.Literal(v):
                kind = {bool: "bool", int: "int", float: "real", str: "string", type(None): UNDEFINED}[type(v)]
                return Value(F.lit(v).cast("long") if kind == "int" else F.lit(v), kind)
            case N.Ref():
                return self.look(node)
            case N.Bucket(column, width):
                ts = self.look(N.Ref(column))
                return Value((F.floor(ts.column / width) * width).cast("long"), "int")
            case N.ListOf(items):
                return Value(F.array(*[self.column(x) for x in items]), "list")
            case N.Unary("!", a):
                return Value(~self.condition(a), "bool")
            case N.Unary(op, a):
                v = self.value(a)
                return Value({"-": lambda: -v.column, "+": lambda: v.column, "~": lambda: F.bitwise_not(v.column)}[op](), v.kind)
            case N.Binary():
                return self.binary(node)
            case N.Choice(c, a, b):
                return _choice(Value(self.condition(c), "bool"), self.value(a), self.value(b))
            case N.Case(arms, other):
                values = [self.value(x) for _, x in arms]
                out = F.when(self.condition(arms[0][0]), values[0].column)
                for (c, _), v in zip(arms[1:], values[1:], strict=True):
                    out = out.when(self.condition(c), v.column)
                last = self.value(other)
                return Value(out.otherwise(last.column), common(*values, last))
            case N.Call(name, args):
                least, make = FUNCTIONS.get(name, (0, None))
                if make is None:
                    raise QueryError(f"unknown function {name!r}")
                if len(args) < least:
                    raise QueryError(f"{name}() takes at least {least} arguments")
                return make([self.value(a) for a in args])
        raise QueryError(f"{type(node).__name__} is not allowed here")

    def binary(self, node: N.Binary) -> Value:
        op = node.op
        if op in ("&&", "||"):
            a, b = self.condition(node.left), self.condition(node.right)
            return Value(a & b if op == "&&" else a | b, "bool")
        a, b = self.value(node.left), self.value(node.right)
        x, y = a.column, b.column
        if op in ("=?=", "=!="):
            if UNDEFINED in (a.kind, b.kind):
                same = (y if a.kind == UNDEFINED else x).isNull()
                return Value(same if op == "=?=" else ~same, "bool")
            if "variant" in (a.kind, b.kind) and a.kind != b.kind:
                a, b = as_kind(a, b.kind), as_kind(b, a.kind)
            x, y = key_of(a), key_of(b)
            apart = {a.kind, b.kind} - {UNDEFINED, "any"}
            same = F.lit(False) if len(apart) == 2 and apart != {"int", "real"} else x.eqNullSafe(y)
            return Value(same if op == "=?=" else ~same, "bool")
        if "variant" in (a.kind, b.kind):
            other = b.kind if a.kind == "variant" else a.kind
            kind = "real" if op in "+-*/%&|^" else "string" if op in ("=~", "!~") or other == "variant" else other
            if other == "variant" and kind == "string":
                a, b = Value(key_of(a), "string"), Value(key_of(b), "string")
            else:
                a, b = as_kind(a, kind), as_kind(b, kind)
            x, y = a.column, b.column
        numbers = ("int", "real")
        if {a.kind, b.kind} & set(numbers) and "string" in (a.kind, b.kind) and op not in ("=~", "!~"):
            a, b = (Value(v.column.try_cast("double"), "real") if v.kind == "string" else v for v in (a, b))
            x, y = a.column, b.column
        if op in ("=~", "!~"):
            found = F.regexp_like(x, y)
            return Value(found if op == "=~" else ~found, "bool")
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if (timed := _on_time(op, a, b, node)) is not None:
                return Value(timed, "bool")
            if self.fold_case and a.kind == b.kind == "string":
                x, y = F.lower(x), F.lower(y)
            return Value(_compare(op, x, y), "bool")
        kind = common(a, b)
        if op == "/":
            if kind == "int":  # truncates, and x / 0 is undefined
                return Value(_int_div(x, y), "int")
            return Value(F.try_divide(x.cast("double"), y.cast("double")), "real")
        if op == "%":
            return Value(F.try_mod(x, y), kind)
        if op in "+-*":
            return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), kind)
        return Value({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op], "int")


_MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
#: Beyond this many seconds there is no timestamp.
MOST_SECONDS = 9_000_000_000_000


def _compare(op: str, x: Column, y: Column) -> Column:
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _on_time(op: str, a: Value, b: Value, node: N.Binary) -> Column | None:
    """A time compared with seconds, its fraction included; with a constant, as a bound on the timestamp itself, which a scan can check."""
    if a.time is None:
        if b.time is None:
            return None
        return _on_time(_MIRRORED[op], b, a, N.Binary(_MIRRORED[op], node.right, node.left))
    if isinstance(node.right, N.Literal) and type(node.right.value) is int and abs(node.right.value) <= MOST_SECONDS:
        return _compare(op, a.time, F.timestamp_seconds(F.lit(node.right.value)).cast(_time_type(a)))
    if b.time is not None:
        return _compare(op, _micros(a), _micros(b))
    if b.kind not in ("int", "real"):
        return None
    return _compare(op, _micros(a) / 1e6, b.column)


def _micros(v: Value) -> Column:
    return F.unix_micros(v.time.cast("timestamp"))


def _time_type(v: Value) -> str:
    return "timestamp_ntz" if "timestamp_ntz" in v.time._jc.toString().lower() else "timestamp"


def _int_div(x: Column, y: Column) -> Column:
    safe = F.when(y != 0, y)
    return F.call_function("div", x, safe)
