"""Run a SELECT as one DataFrame plan.

Catalyst sees the whole query: filters and columns reach the scan, aggregates are partial before the shuffle, ORDER
BY with LIMIT is a top-k, and QUALIFY on a rank becomes a group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import Compiler, Value, as_kind, key_of, kind_of, resolver
from ..plans import nodes as N
from ..plans.checks import group_level, grouping
from ..plans.lexer import QueryError


def names(items: list[N.Item]) -> list[str]:
    """Result headers; a header that comes again gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for i in items:
        seen[i.header.lower()] = n = seen.get(i.header.lower(), 0) + 1
        out.append(i.header if n == 1 else f"{i.header}_{n}")
    return out


def star_order(df: DataFrame, key: str = "Key") -> DataFrame:
    """The key first, then the other columns by name; columns that start with an underscore are left out."""
    cols = sorted((c for c in df.columns if not c.startswith("_")), key=lambda c: (c.lower() != key.lower(), c))
    look = resolver(df)
    return df.select(*[look(N.Ref(c)).column.alias(c) for c in cols])


def aggregate_column(node: N.Aggregate, df: DataFrame, fold_case: bool = False) -> Value:
    """One aggregate; a column that isn't numeric is read as a number where it can be."""
    compiler = Compiler(resolver(df), fold_case=fold_case)
    where = compiler.condition(node.where) if node.where is not None else None

    def kept(c: Column) -> Column:
        return c if where is None else F.when(where, c)

    if node.column == "*":
        return Value(F.count(kept(F.lit(1))), "int")
    v = compiler.value(N.Ref(node.column))
    if node.name == "COUNT":
        return Value((F.count_distinct if node.distinct else F.count)(kept(key_of(v))), "int")
    v = as_kind(v, "real")
    x = v.column.cast("long") if v.kind == "bool" else v.column if v.kind in ("int", "real") else v.column.try_cast("double")
    make = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[node.name]
    kind = "real" if node.name == "AVG" or v.kind not in ("int", "bool") else "int"
    return Value(make(kept(x)), kind)


def _order_of(v: Value) -> Column:
    """What a value sorts by: a time by its timestamp, of which it shows whole seconds."""
    return v.time if v.time is not None else key_of(v)


def _terms(order: list[tuple[Column, bool]], undefined_last: bool) -> list[Column]:
    """Undefined sorts after everything, so first when descending, or last in either direction."""
    return [(c.desc_nulls_last() if undefined_last else c.desc_nulls_first()) if down else c.asc_nulls_last() for c, down in order]


def _sorted(df: DataFrame, order: list[tuple[Column, bool]], limit: int, undefined_last: bool = False) -> DataFrame:
    if order:
        df = df.orderBy(*_terms(order, undefined_last))
    return df.limit(limit) if limit else df


def run_select(df: DataFrame, st: N.Select, fold_case: bool = False, undefined_last: bool = False) -> DataFrame:
    """`df` is the table that the statement names; with `undefined_last`, undefined sorts last also when descending, as in DuckDB."""
    compiler = Compiler(resolver(df), fold_case=fold_case)
    if st.where is not None:
        df = df.filter(compiler.condition(st.where))
    aggregated = st.group or st.having is not None or any(N.has(i.node, N.Aggregate) for i in st.items)
    if aggregated:
        return _aggregate(df, st, fold_case, undefined_last)
    if any(isinstance(i.node, N.Ranking) for i in st.items):
        return _rank(df, st, compiler, undefined_last)
    if st.star:
        if not st.distinct:
            return star_order(_sorted(df, [(_order_of(compiler.value(n)), d) for n, d in st.order], st.limit, undefined_last))
        out = star_order(df)
        out = out.select(*[key_of(compiler.value(N.Ref(c))).alias(c) for c in out.columns]).distinct()
        compiler = Compiler(resolver(out), fold_case=fold_case)
        return _sorted(out, [(key_of(compiler.value(n)), d) for n, d in st.order], st.limit, undefined_last)
    heads = names(st.items)
    if st.distinct:
        out = df.select(*[key_of(compiler.value(i.node)).alias(h) for i, h in zip(st.items, heads, strict=True)]).distinct()
        return _sorted(out, _output_order(st, out, heads), st.limit, undefined_last)
    # sort by a column of the table or of the result, before columns are dropped
    own = {h.lower(): i.node for i, h in zip(st.items, heads, strict=True) if i.alias}
    order = [(_order_of(compiler.value(own.get(n.name.lower(), n) if isinstance(n, N.Ref) else n)), d) for n, d in st.order]
    return _sorted(df, order, st.limit, undefined_last).select(*[compiler.column(i.node).alias(h) for i, h in zip(st.items, heads, strict=True)])


def _output_order(st: N.Select, out: DataFrame, heads: list[str]) -> list[tuple[Column, bool]]:
    result = []
    for node, down in st.order:
        for i, h in zip(st.items, heads, strict=True):
            if i.node == node or isinstance(node, N.Ref) and node.name.lower() == h.lower():
                result.append((F.col(f"`{h}`"), down))
                break
        else:
            raise QueryError("ORDER BY term is not a selected column")
    return result


def _aggregate(df: DataFrame, st: N.Select, fold_case: bool, undefined_last: bool) -> DataFrame:
    compiler = Compiler(resolver(df), fold_case=fold_case)
    keys = grouping(st)
    for k in keys:
        if isinstance(k, N.Bucket):  # rows without a time are in no bucket
            df = df.filter(compiler.column(N.Ref(k.column)).isNotNull())
    sums: dict[N.Aggregate, Value] = {}
    for node in [i.node for i in st.items] + ([st.having] if st.having is not None else []):
        for x in N.walk(node):
            if isinstance(x, N.Aggregate) and x not in sums:
                sums[x] = aggregate_column(x, df, fold_case)
    key_values = [Value(key_of(v), "string" if v.kind == "variant" else v.kind) for v in map(compiler.value, keys)]
    grouped = df.groupBy(*[v.column.alias(f"_k{n}") for n, v in enumerate(key_values)])
    # the list is never empty, so that a SELECT without aggregates works as well
    out = grouped.agg(*([v.column.alias(f"_a{n}") for n, v in enumerate(sums.values())] or [F.count(F.lit(1)).alias("_a")]))
    made = {k: Value(F.col(f"_k{n}"), key_values[n].kind) for n, k in enumerate(keys)}
    made |= {a: Value(F.col(f"_a{n}"), v.kind) for n, (a, v) in enumerate(sums.items())}
    aliases = {i.alias.lower(): i.node for i in st.items if i.alias}
    plain = {k.name.lower(): v for k, v in made.items() if isinstance(k, N.Ref)}

    def extra(node: N.Node) -> Value | None:
        if node in made:
            return made[node]
        if isinstance(node, N.Ref):
            return plain.get(node.name.lower())
        return None

    def look(ref: N.Ref) -> Value:
        if ref.name.lower() in aliases:
            return after.value(aliases[ref.name.lower()])
        return Value(F.lit(None), "null")

    after = Compiler(look, extra, fold_case)
    if st.having is not None:
        out = out.filter(after.condition(st.having))
    heads = names(st.items)
    out = out.select(*[after.column(i.node).alias(h) for i, h in zip(st.items, heads, strict=True)])
    if st.distinct:
        out = out.distinct()
    return _sorted(out, _output_order(st, out, heads), st.limit, undefined_last)


def _rank(df: DataFrame, st: N.Select, compiler: Compiler, undefined_last: bool) -> DataFrame:
    heads = names(st.items)
    functions = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}
    ranked: dict[str, str] = {}
    for n, (i, h) in enumerate(zip(st.items, heads, strict=True)):
        if not isinstance(i.node, N.Ranking):
            continue
        terms = [(_order_of(compiler.value(t)), d) for t, d in i.node.order]
        if i.node.name == "ROW_NUMBER":  # ties in the order of the table, as far as it has one
            terms += [(F.col(f"`{c}`"), False) for c in df.columns if c in ("_seq", "Key")]
        spec = Window.partitionBy(*[key_of(compiler.value(N.Ref(p))) for p in i.node.partition]).orderBy(*_terms(terms, undefined_last))
        df = df.withColumn(f"_r{n}", functions[i.node.name]().over(spec))
        ranked[h.lower()] = f"_r{n}"

    def extra(node: N.Node) -> Value | None:
        if isinstance(node, N.Ref) and node.name.lower() in ranked:
            return Value(F.col(ranked[node.name.lower()]), "int")
        if isinstance(node, N.Ranking):
            return next(Value(F.col(ranked[h.lower()]), "int") for i, h in zip(st.items, heads, strict=True) if i.node == node)
        return None

    after = Compiler(resolver(df), extra, compiler.fold_case)
    if st.qualify is not None:
        df = df.filter(after.condition(st.qualify))
    out = df.select(*[after.column(i.node).alias(h) for i, h in zip(st.items, heads, strict=True)])
    return _sorted(out, _output_order(st, out, heads), st.limit, undefined_last)


__all__ = ["aggregate_column", "group_level", "kind_of", "names", "run_select", "star_order"]
