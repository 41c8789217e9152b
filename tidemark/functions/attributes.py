"""Attributes that hold expressions over other attributes of their row.

Beside a column C, a column of text holds the expressions of the rows that have one.  The distinct texts are few in
practice; each is compiled once and a row picks its own by comparison, so that Catalyst sees one plan.  A reference to
another attribute is that attribute's value, evaluated in turn; one that leads back to the attribute is undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import nodes as N
from ..plans.parser import parse_expression
from .expressions import UNDEFINED, Compiler, Resolver, Value, common, resolver

#: Prefix of the columns of expression text.
TEXT = "_text_"


def evaluating(rows: DataFrame, texts: dict[str, list[str]]) -> Resolver:
    """Look up attributes with their expressions evaluated; `texts`: by column of text, all expressions there."""
    plain = resolver(rows)
    own = {c[len(TEXT) :].lower(): (c, found) for c, found in texts.items() if c in rows.columns}

    def within(active: frozenset[str]) -> Resolver:
        def look(ref: N.Ref) -> Value:
            name = ref.name.lower()
            if ref.scope == "TARGET" or name in active:
                return Value(F.lit(None), UNDEFINED)
            base = plain(ref)
            if name not in own:
                return base
            column, found = own[name]
            compiler = Compiler(within(active | {name}))
            values = [(t, compiler.value(parse_expression(t))) for t in dict.fromkeys(found)]
            kind = common(base, *[v for _, v in values])
            return Value(_picked(F.col(f"`{column}`"), base, values, kind), kind)

        return look

    return within(frozenset())


def _picked(text: Column, base: Value, values: list[tuple[str, Value]], kind: str) -> Column:
    def shaped(v: Value) -> Column:
        return F.to_variant_object(v.column) if kind == "variant" and v.kind == "list" else v.column.cast("variant") if kind == "variant" and v.kind != "variant" else v.column

    out = shaped(base)
    for t, v in values:
        out = F.when(text == t, shaped(v)).otherwise(out)
    return out


def evaluated(rows: DataFrame, texts: dict[str, list[str]]) -> DataFrame:
    """The rows with values in place of expressions."""
    if not texts:
        return rows
    look = evaluating(rows, texts)
    hidden = {c.lower() for c in texts}
    shown = {c[len(TEXT) :].lower(): c[len(TEXT) :] for c in texts if c in rows.columns}
    columns = [look(N.Ref(c)).column.alias(c) if c.lower() in shown else F.col(f"`{c}`") for c in rows.columns if c.lower() not in hidden]
    have = {c.lower() for c in rows.columns}
    columns += [look(N.Ref(c)).column.alias(c) for low, c in shown.items() if low not in have]
    return rows.select(*columns)
