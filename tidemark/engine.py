"""Statements in, DataFrames out."""

from __future__ import annotations

import datetime
import re
import time

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .functions.attributes import TEXT, evaluated, evaluating
from .functions.expressions import Compiler, resolver
from .operators.match import run_match
from .operators.select import names, run_select
from .operators.timeline import latest
from .plans import nodes as N
from .plans.checks import grouping
from .plans.lexer import QueryError
from .plans.parser import parse
from .sources.archive import Archive
from .sources.catalog import Catalog
from .sources.changelog import META, ChangeLog, MemoryLog, union

KEY = "Key"


def render(value: object) -> str:
    """A parameter as a literal of the dialect."""
    if value is None:
        return "UNDEFINED"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise QueryError("an integer parameter must fit in 64 bits")
        return str(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise QueryError("NaN and infinity have no literal")
        return repr(value)
    if isinstance(value, datetime.datetime):
        return str(int(value.timestamp()))
    if isinstance(value, datetime.date):
        return str(int(datetime.datetime(value.year, value.month, value.day).timestamp()))
    if isinstance(value, list | tuple):
        return "{" + ", ".join(map(render, value)) + "}"
    if hasattr(value, "as_tuple"):  # Decimal
        return render(float(value))
    return "'" + str(value).replace("'", "''") + "'"


def bind(text: str, params: list | tuple = ()) -> str:
    """Put parameters in place of question marks outside strings."""
    left = list(params)

    def put(m: re.Match) -> str:
        if m[0] != "?":
            return m[0]
        if not left:
            raise QueryError("more parameter marks than parameters")
        return render(left.pop(0))

    out = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|=\?=|\?", put, text) if params else text
    if left:
        raise QueryError("more parameters than parameter marks")
    return out


def point_in_time(text: str, now: float | None = None) -> float:
    """Seconds since the epoch for a timestamp, a date (local time), or an offset from now such as -1h30m."""
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d+)?(?:ms|h|m|s))+)", text.strip())
    if m:
        span = sum(float(n) * {"h": 3600, "m": 60, "s": 1, "ms": 0.001}[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", m[2]))
        return (time.time() if now is None else now) + (span if m[1] == "+" else -span)
    try:
        return datetime.datetime.fromisoformat(text.strip()).timestamp()
    except ValueError as e:
        raise QueryError(f"invalid AS OF time {text!r}") from e


class Engine:
    """Tables are change logs below `root`, in memory, or frames registered as views.

    Writes go through a change log; outside a transaction each statement is one commit.  A transaction binds to the
    first table that it writes, reads of that table see its writes, and its net change of each key is one commit.
    Tables, views, archives and indexes last; tables in memory and registered frames go with the engine.

    An attribute may hold an expression over others.  It is stored as text beside the values and evaluated when a
    row is read; one that refers to itself, over others or not, is undefined.
    """

    def __init__(self, spark: SparkSession, root: str, clock=time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.catalog = Catalog(spark, f"{self.root}/catalog")
        self.frames: dict[str, DataFrame] = {}
        self.memory: dict[str, MemoryLog] = {}
        self.views: dict[str, N.Create] = {n: parse(text) for n, text in self.catalog.all("views").items()}
        self.archives: dict[str, Archive] = {n: Archive(spark, f"{self.root}/archives", n, at) for n, at in self.catalog.all("archives").items()}
        self.indexes: dict[tuple[str, str], str] = {tuple(n.split("/", 1)): kind for n, kind in self.catalog.all("indexes").items()}
        self.pending: list[tuple[DataFrame, dict[str, list[str]], int]] | None = None  # events, expressions, keys made
        self.bound: str | None = None

    # tables

    def register(self, name: str, df: DataFrame) -> None:
        """Make a frame readable under a name."""
        self.frames[name.lower()] = df

    def archive(self, name: str, time: str) -> Archive:
        """An archive table; a name of its own, apart from the other tables."""
        low = name.lower()
        if low not in self.archives:
            self.catalog.put("archives", low, time)
            self.archives[low] = Archive(self.spark, f"{self.root}/archives", low, time)
        return self.archives[low]

    def log(self, name: str) -> ChangeLog | MemoryLog:
        return self.memory.get(name.lower()) or ChangeLog(self.spark, f"{self.root}/tables", name.lower())

    def tables(self) -> list[str]:
        fs, path = self.log("x")._fs(f"{self.root}/tables")
        stored = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted({*self.frames, *self.memory, *self.views, *self.archives, *stored})

    def table(self, name: str, as_of: str | None = None) -> DataFrame:
        """Rows to read, with expressions evaluated."""
        low = name.lower()
        if low in self.views:
            return self.refresh(low)
        if low in self.frames:
            if as_of is not None:
                raise QueryError(f"{name} keeps no history, so AS OF has nothing to read")
            return self.frames[low]
        if low in self.archives:
            if as_of is not None:
                raise QueryError(f"{name} is an archive, which AS OF doesn't read")
            return self.archives[low].rows()
        rows, texts = self._stored(low, as_of)
        return evaluated(rows, texts)

    def _stored(self, low: str, as_of: str | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
        """A log's rows as stored, and the expressions among them."""
        log = self.log(low)
        if not log.exists() and not (self.bound == low and self.pending):
            raise QueryError(f"no such table {low!r}")
        if as_of is not None:
            return log.rows(point_in_time(as_of, self.clock())), log.texts()
        rows, texts = log.rows(), log.texts()
        if self.bound == low and self.pending:
            for _, new, _ in self.pending:
                for c, found in new.items():
                    texts[c] = [*texts.get(c, []), *found]
            rows = self._net(rows).filter(F.col("_op") != "delete")
        return rows, texts

    def _net(self, rows: DataFrame | None = None) -> DataFrame:
        """The transaction's last event of each key, over a snapshot's rows if given."""
        events = None if rows is None else rows.withColumn("_batch", F.lit(-1))
        for k, (batch, _, _) in enumerate(self.pending):
            batch = batch.withColumn("_batch", F.lit(k))
            events = batch if events is None else union(events, batch)
        return latest(events, "_key", ["_batch"]).drop("_batch")

    # statements

    def sql(self, text: str, params: list | tuple = ()) -> DataFrame:
        """Run one statement.  Statements without rows give one row with the number of rows changed."""
        st = parse(bind(text, params))
        match st:
            case N.Select():
                return self.select(st)
            case N.Explain():
                return self.explain(st)
            case N.Match():
                return run_match(self.spark, st, self._texts_in_place(st.requests), self._texts_in_place(st.resources))
            case N.Watch():
                from .streaming.watch import replay

                return replay(self, st)
            case N.Insert():
                return self._done(self.insert(st))
            case N.Update():
                return self._done(self.update(st))
            case N.Delete():
                return self._done(self.delete(st))
            case N.Create():
                return self._done(self.create(st, bind(text, params)))
            case N.Drop():
                return self._done(self.drop(st))
            case N.Transaction(action):
                return self._done(getattr(self, action.lower())())
        raise QueryError(f"unsupported statement {type(st).__name__}")

    def _done(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([Row(rows=n)], "rows long")

    def _texts_in_place(self, name: str) -> DataFrame:
        """A table whose expressions are columns of text."""
        low = name.lower()
        if low in self.views or low in self.frames or low in self.archives:
            return self.table(low)
        rows, texts = self._stored(low)
        for x in texts:
            own = next((c for c in rows.columns if c.lower() == x[len(TEXT) :].lower()), x[len(TEXT) :])
            rows = rows.withColumn(own, F.coalesce(F.col(f"`{x}`"), F.col(f"`{own}`").cast("string")) if own in rows.columns else F.col(f"`{x}`")).drop(x)
        return rows

    def select(self, st: N.Select) -> DataFrame:
        return run_select(self.table(st.table, st.as_of), st)

    def explain(self, st: N.Explain) -> DataFrame:
        df = self.select(st.query)
        lines = [f"scan: {st.query.table}"]
        if st.query.limit:
            how = "applied after ORDER BY, as a top-k" if st.query.order else "pushed to the scan"
            lines.append(f"limit: {st.query.limit} {how}")
        if st.analyze:
            began = time.time()
            lines.append(f"rows: {df.count()}, seconds: {time.time() - began:.3f}")
        lines += df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n")
        return self.spark.createDataFrame([(x,) for x in lines], "`QUERY PLAN` string")

    # writes

    def _commit(self, table: str, events: DataFrame, texts: dict[str, list[str]] | None = None, made: int = 0) -> int:
        """Events of distinct keys."""
        low = table.lower()
        if low in self.frames or low in self.views or low in self.archives:
            raise QueryError(f"{table} cannot be written")
        if self.pending is not None:
            if self.bound not in (None, low):
                raise QueryError(f"this transaction is on {self.bound}, so it cannot write {table}")
            self.bound = low
            self.pending.append((events, texts or {}, made))
            return events.count()
        log = self.log(low)
        log.create()
        return log.append(events, self.clock(), texts, made=made)

    def insert(self, st: N.Insert) -> int:
        values, texts = {}, {}
        for column, node in st.values.items():
            if any(isinstance(x, N.Ref) for x in N.walk(node)):
                values[TEXT + column], texts[TEXT + column] = F.lit(st.texts[column]), [st.texts[column]]
            else:
                values[column] = Compiler(lambda r: None).column(node)
        name = next((c for c in values if c.lower() == KEY.lower()), None)
        if name is None:
            made = self.log(st.table).made() + sum(m for _, _, m in self.pending or [])
            values[KEY] = F.lit(f"row-{made + 1}")
        key = values.pop(name or KEY).cast("string")
        one = self.spark.range(0, 1, 1, 1).select(F.lit("upsert").alias("_op"), key.alias("_key"), key.alias(KEY), *[c.alias(n) for n, c in values.items()])
        return self._commit(st.table, one, texts, int(name is None))

    def _matching(self, table: str, where: N.Node | None) -> DataFrame:
        """Stored rows for which a condition on the evaluated ones holds."""
        low = table.lower()
        if low in self.frames or low in self.views or low in self.archives:
            raise QueryError(f"{table} cannot be written")
        rows, texts = self._stored(low)
        if where is None:
            return rows
        look = evaluating(rows, texts)
        return rows.filter(Compiler(look).condition(where))

    def update(self, st: N.Update) -> int:
        """Stores values: an expression is evaluated now, on each row."""
        if any(c.lower() == KEY.lower() for c in st.values):
            raise QueryError("UPDATE cannot set the key")
        rows = self._matching(st.table, st.where)
        texts = self.log(st.table).texts()
        compiler = Compiler(evaluating(rows, texts))
        changed = rows.select("*", *[compiler.column(n).alias(f"_new{k}") for k, n in enumerate(st.values.values())])
        for k, c in enumerate(st.values):
            own = next((x for x in rows.columns if x.lower() == c.lower()), c)
            changed = changed.withColumn(own, F.col(f"_new{k}")).drop(f"_new{k}", *[x for x in rows.columns if x.lower() == (TEXT + c).lower()])
        return self._commit_rows(st.table, changed, "upsert")

    def delete(self, st: N.Delete) -> int:
        return self._commit_rows(st.table, self._matching(st.table, st.where), "delete")

    def truncate(self, table: str) -> int:
        return self._commit_rows(table, self._matching(table, None), "delete")

    def _commit_rows(self, table: str, rows: DataFrame, op: str) -> int:
        return self._commit(table, rows.drop("_seq", "_ts", "_op").withColumn("_op", F.lit(op)))

    def write_rows(self, table: str, rows: DataFrame, key: str = KEY) -> tuple[int, DataFrame]:
        """Replace whole rows; returns how many, and the rows refused (no key, or a key that comes twice)."""
        count = F.count(F.lit(1)).over(Window.partitionBy(key))
        marked = rows.withColumn("_count", count)
        bad = marked.filter(F.col(key).isNull() | (F.col("_count") > 1)).drop("_count")
        good = marked.filter(F.col(key).isNotNull() & (F.col("_count") == 1)).drop("_count").withColumn("_key", F.col(key).cast("string"))
        return self._commit_rows(table, good, "upsert"), bad

    # definitions

    def create(self, st: N.Create, text: str) -> int:
        if st.kind == "TABLE":
            if st.memory:
                self.memory.setdefault(st.name.lower(), MemoryLog(self.spark, st.name.lower()))
            else:
                self.log(st.name).create()
        elif st.kind == "INDEX":
            for c in st.columns:
                self.index(st.name, c, st.index)
        else:
            self.catalog.put("views", st.name.lower(), text)
            self.views[st.name.lower()] = st
        return 0

    def index(self, table: str, column: str, kind: str | None = "VALUE") -> bool:
        """Note an index, or drop it (kind None); indexes advise how files are sorted."""
        at = (table.lower(), column)
        if kind is None:
            self.catalog.remove("indexes", "/".join(at))
            return self.indexes.pop(at, None) is not None
        self.catalog.put("indexes", "/".join(at), kind)
        self.indexes[at] = kind
        return True

    def drop(self, st: N.Drop) -> int:
        low = st.name.lower()
        if st.kind == "TABLE":
            if self.frames.pop(low, None) is None:
                self.log(low).drop()
                self.memory.pop(low, None)
        elif st.kind == "INDEX":
            for c in st.columns:
                self.index(low, c, None)
        else:
            self.catalog.remove("views", low)
            self.views.pop(low, None)
            self._sealed(low).drop()
        return 0

    def _sealed(self, name: str) -> ChangeLog:
        return ChangeLog(self.spark, f"{self.root}/views", name)

    def seal(self, name: str, until: float | None = None) -> dict:
        """Append a continuous aggregate's buckets that ended `grace` before its newest row, or before `until`, each
        once.  Returns its note: sealed (the end of the last such bucket), cursor, late (rows that came too late)."""
        view = self.views[name.lower()]
        bucket_ = next(k for k in grouping(view.query) if isinstance(k, N.Bucket))
        log, store = self.log(view.query.table), self._sealed(name.lower())
        rows = self.table(view.query.table)
        compiler = Compiler(resolver(rows))
        at, slot = compiler.column(N.Ref(bucket_.column)), compiler.column(bucket_)
        store.create()
        note = {"sealed": None, "cursor": 0, "late": 0} | store.note()
        sealed = note["sealed"]
        late = (F.col("_seq") > note["cursor"]) & (slot < sealed) if sealed is not None else F.lit(False)
        newest, came_late = rows.agg(F.max(at), F.count(F.when(late, 1))).first()
        if newest is None:
            return note
        end = int(((newest if until is None else until) - view.grace) // bucket_.width * bucket_.width)
        following = {"sealed": end if sealed is None else max(sealed, end), "cursor": log.head(), "late": note["late"] + came_late}
        if following != note:
            ripe = slot < following["sealed"] if sealed is None else (slot >= sealed) & (slot < following["sealed"])
            out = run_select(rows.filter(ripe), view.query)
            store.append(out.withColumn("_op", F.lit("upsert")).withColumn("_key", F.to_json(F.struct(*out.columns))), self.clock(), note=following)
        return following

    def refresh(self, name: str) -> DataFrame:
        """A view's rows; too many series are an error.

        A continuous aggregate is sealed as far as its newest row says, and has its sealed buckets and the open ones.
        Buckets that ended `retention` before the newest one's start are left out.
        """
        view = self.views[name]
        keys = grouping(view.query)
        slot = next((i for i in view.query.items if isinstance(i.node, N.Bucket) and i.node in keys), None)
        if slot is not None and self.log(view.query.table).exists():
            sealed = self.seal(name)["sealed"]
            rows = self.table(view.query.table)
            if sealed is not None:
                rows = rows.filter(Compiler(resolver(rows)).column(slot.node) >= sealed)
            out = run_select(rows, view.query)
            store = self._sealed(name).rows()
            if set(out.columns) <= set(store.columns):
                out = union(store.select(*out.columns), out)
        else:
            out = self.select(view.query)
        if view.retention:
            at = names(view.query.items)[view.query.items.index(slot)]
            newest = out.agg(F.max(f"`{at}`")).first()[0]
            if newest is not None:
                out = out.filter(F.col(f"`{at}`") + slot.node.width > newest - view.retention)
        if out.limit(view.max_series + 1).count() > view.max_series:
            raise QueryError(f"the view {name} has more than {view.max_series} series")
        return out

    # transactions

    def begin(self) -> int:
        if self.pending is not None:
            raise QueryError("BEGIN inside a transaction; they do not nest")
        self.pending, self.bound = [], None
        return 0

    def commit(self) -> int:
        """The net change of each key as one commit; returns how many keys changed."""
        if self.pending is None:
            raise QueryError("there is no transaction to commit")
        if not self.pending:
            self.pending = self.bound = None
            return 0
        net, log, texts = self._net(), self.log(self.bound), {}
        for _, new, _ in self.pending:
            for c, found in new.items():
                texts[c] = [*texts.get(c, []), *found]
        log.create()
        n = log.append(net, self.clock(), texts, made=sum(m for _, _, m in self.pending))
        self.pending = self.bound = None  # kept if the commit fails
        return n

    def rollback(self) -> int:
        if self.pending is None:
            raise QueryError("there is no transaction to roll back")
        self.pending = self.bound = None
        return 0


__all__ = ["Engine", "META", "bind", "point_in_time", "render"]
