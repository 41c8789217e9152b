"""Statements and dot commands of an interactive session, as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .engine import Engine
from .plans.lexer import QueryError
from .plans.parser import parse_expression
from .sources.exposition import exposition
from .sources.records import render


class Shell:
    """`run` takes a line and returns what to show."""

    def __init__(self, engine: Engine):
        self.engine, self.table, self.format = engine, "ads", "table"
        self.retention: dict[str, int] = {}

    def run(self, line: str) -> str:
        line = line.strip()
        if line.startswith("."):
            name, *args = line[1:].split()
            command = getattr(self, f"do_{name}", None)
            return command(*args) if command else f"unknown command .{name}"
        try:
            return self.show(self.engine.sql(line))
        except QueryError as e:
            return f"error: {e}"

    def show(self, df) -> str:
        if self.format == "table":
            return df._jdf.showString(1000, 0, False)
        return "\n".join(r["value"] for r in render(df, self.format).collect())

    def do_help(self) -> str:
        return "\n".join(sorted(f".{x[3:]}" for x in dir(self) if x.startswith("do_")))

    def do_format(self, name: str = "") -> str:
        if name not in ("table", "json", "old", "new"):
            return "format is table, json, old or new"
        self.format = name
        return f"format {name}"

    def do_tables(self) -> str:
        return "\n".join(self.engine.tables())

    def do_use(self, table: str) -> str:
        self.table = table
        return f"using {table}"

    def do_stats(self, table: str = "") -> str:
        log = self.engine.log(table or self.table)
        if not log.exists():
            return f"rows {self.engine.table(table or self.table).count()}"
        return f"rows {log.rows().count()}\nevents {log.events().count()}\nlast {log.head()}"

    def do_schema(self, table: str = "") -> str:
        """Each column's type and the share of rows without a value."""
        df = self.engine.table(table or self.table)
        shown = [f for f in df.schema.fields if not f.name.startswith("_")]
        row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f"`{f.name}`").alias(f.name) for f in shown]).first()
        n = row["_n"] or 1
        return "\n".join(f"{f.name} {f.dataType.simpleString()} missing {1 - row[f.name] / n:.2f}" for f in shown)

    def do_indexes(self, table: str = "") -> str:
        mine = (table or self.table).lower()
        return "\n".join(f"{c} {kind}" for (t, c), kind in sorted(self.engine.indexes.items()) if t == mine) or "none"

    def do_addindex(self, column: str, table: str = "") -> str:
        self.engine.index(table or self.table, column)
        return "added; it advises how files are sorted"

    def do_dropindex(self, column: str, table: str = "") -> str:
        return "dropped" if self.engine.index(table or self.table, column, None) else "no such index"

    def do_explain(self, *words: str) -> str:
        from .functions.expressions import Compiler, resolver

        df = self.engine.table(self.table)
        plan = df.filter(Compiler(resolver(df)).condition(parse_expression(" ".join(words))))
        return plan._jdf.queryExecution().toString()

    def do_compact(self, table: str = "") -> str:
        self.engine.log(table or self.table).compact()
        return "compacted"

    def do_truncate(self, table: str = "") -> str:
        if not table:
            return "name a table to truncate"
        return f"{self.engine.truncate(table)} rows deleted"

    def do_memory(self, table: str = "") -> str:
        name = table or self.table
        self.engine.register(name, self.engine.table(name).cache())
        return f"{name} is in memory"

    def do_views(self) -> str:
        return "\n".join(sorted(self.engine.views)) or "none"

    def do_export(self, view: str = "") -> str:
        names = [view.lower()] if view else sorted(self.engine.views)
        return "\n".join(r["line"] for v in names for r in exposition(self.engine.refresh(v), v).orderBy("line").collect())

    def do_timetravel(self, *args: str) -> str:
        if args and args[0] == "off":
            self.retention.pop(self.table, None)
        elif len(args) > 1:
            from .plans.parser import seconds

            self.retention[self.table] = seconds(args[1])
        return f"history kept: {self.retention.get(self.table, 'all')}"

    def do_exporters(self) -> str:
        return "\n".join(str(q.name or q.id) for q in self.engine.spark.streams.active) or "none"

    def do_retention(self, days: str = "", table: str = "") -> str:
        """Drop the oldest days of an archive beyond so many."""
        archive = self.engine.archives.get((table or self.table).lower())
        if archive is None:
            return "not an archive"
        gone = archive.retain(0, most_days=int(days)) if days else []
        return f"days kept: {len(archive.days())}, dropped: {len(gone)}"

    do_rotate = do_retention

    def do_suggest(self, table: str = "") -> str:
        """Columns of small cardinality are good to partition by, those with many values to sort by."""
        df = self.engine.table(table or self.table)
        shown = [c for c in df.columns if not c.startswith("_")]
        row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(f"`{c}`").alias(c) for c in shown]).first()
        return "\n".join(f"{c} {'partition' if row[c] <= 100 and row[c] * 100 < row['_n'] else 'sort' if row[c] * 2 > row['_n'] else '-'}" for c in shown)

    def do_exporter(self, name: str = "") -> str:
        found = [q for q in self.engine.spark.streams.active if name in (q.name, str(q.id))]
        return str(found[0].lastProgress) if found else "no such exporter"

    def do_analyze(self) -> str:
        return "statistics come from the files"

    def do_hot(self) -> str:
        return "columns are read as needed; there is no hot set"

    do_addhot = do_refreshhot = lambda self, *a: self.do_hot()
    do_rewrite = do_retrain = do_reindex = lambda self, *a: self.do_compact(*a)
