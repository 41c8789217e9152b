"""Tables as change logs.

A table is a folder of Parquet, one subfolder a commit, and of numbered records that name the committed ones, so a
commit that breaks off leaves nothing behind that is read.  A record is never replaced: two writers that race for a
number leave one of them with an error.  A commit is written below `_staging`, made by its record, and then moved
below `data`, so a stream over `data` sees committed files only.  Every event has

- ``_seq``: increases from commit to commit and differs within one, with gaps;
- ``_ts``: when it was committed, in seconds since the epoch;
- ``_op``: upsert or delete;
- ``_key``: the storage key, at most once a commit;

and the whole row after the change, so no reader needs what was there before.  Commits may give a column different
types: whole and real numbers are read as reals, anything else as VARIANT.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timeline import latest
from ..plans.lexer import QueryError

META = ("_seq", "_ts", "_op", "_key")
EMPTY = "_seq long, _ts double, _op string, _key string, Key string"
#: Every so many records one names all commits, so that a reader opens few.
FULL = 32


def _unified(kinds: list[T.DataType]) -> T.DataType:
    """The type that a column of these types is read as."""
    distinct = {k.simpleString(): k for k in kinds if not isinstance(k, T.NullType)}
    if len(distinct) <= 1:
        return next(iter(distinct.values()), T.NullType())
    if all(isinstance(k, T.NumericType) for k in distinct.values()):
        return T.LongType() if all(isinstance(k, T.IntegralType) for k in distinct.values()) else T.DoubleType()
    return T.VariantType()


def _numbered(events: DataFrame, first: int, at: float) -> DataFrame:
    """Events with numbers from `first` on: of an `_order` column if there is one, else unique ones."""
    order = F.col("_order") if "_order" in events.columns else F.monotonically_increasing_id()
    return events.withColumn("_seq", order + first).withColumn("_ts", F.lit(float(at))).drop("_order")


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.root = spark, name, f"{root.rstrip('/')}/{name}"

    # the records, through Spark's file systems

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, path = self._fs(f"{self.root}/_log")
        if not fs.exists(path):
            return []
        return sorted(int(n[:-5]) for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def _record(self, version: int) -> dict:
        fs, path = self._fs(f"{self.root}/_log/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self) -> dict:
        """version (0: no table), next number, and the commits: folder, schema, rows, and bytes where known."""
        versions, records = self._versions(), []
        for v in reversed(versions):
            records.append(self._record(v))
            if records[-1]["full"]:
                break
        commits = [c for r in reversed(records) for c in r["commits"]]
        staged = self._staged()
        for c in commits:  # made, but not moved yet
            if c["folder"].removeprefix("data/") in staged:
                c["folder"] = c["folder"].replace("data/", "_staging/")
        return {"version": versions[-1] if versions else 0, "next": records[0]["next"] if records else 1, "commits": commits}

    def _staged(self) -> set[str]:
        fs, path = self._fs(f"{self.root}/_staging")
        return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()

    def _settle(self, commits: list[dict]) -> None:
        """Move committed folders to their place."""
        for c in commits:
            name = c["folder"].rpartition("/")[2]
            fs, to = self._fs(f"{self.root}/data/{name}")
            fs.mkdirs(to.getParent())
            fs.rename(self._fs(f"{self.root}/_staging/{name}")[1], to)

    def _put(self, version: int, record: dict) -> None:
        """Write a record under a number that must be free; it appears whole."""
        fs, temporary = self._fs(f"{self.root}/_log/{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        _, path = self._fs(f"{self.root}/_log/{version:012d}.json")
        jvm, options = self.spark._jvm, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, path, options)
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if fs.exists(path):
                raise QueryError(f"table {self.name} was changed by another writer; try again") from e
            raise

    def _commit(self, state: dict, commits: list[dict], following: int) -> None:
        version = state["version"] + 1
        full = version % FULL == 1
        late = [c for c in state["commits"] if c["folder"].startswith("_staging/")]  # of a writer that broke off
        for c in state["commits"]:
            c["folder"] = c["folder"].replace("_staging/", "data/")
        self._put(version, {"full": full, "next": following, "commits": [*state["commits"], *commits] if full else commits})
        self._settle([*late, *commits])

    def create(self) -> None:
        if not self.exists():
            self._put(1, {"full": True, "next": 1, "commits": []})

    def exists(self) -> bool:
        return bool(self._versions())

    def drop(self) -> None:
        fs, path = self._fs(self.root)
        fs.delete(path, True)

    def head(self) -> int:
        """A number that no event so far exceeds."""
        return self._state()["next"] - 1

    def commits(self) -> list[str]:
        """The committed folders."""
        return [c["folder"] for c in self._state()["commits"]]

    def append(self, events: DataFrame, at: float | None = None, texts: dict[str, list[str]] | None = None, note: dict | None = None, made: int = 0) -> int:
        """Commit events (_op, _key and the row's columns); returns how many there were.

        Numbers are given while the events are written: nothing is evaluated twice.  `texts` names the expressions
        that came new in columns of expression text, `made` is how many keys were generated; a `note` is kept with the
        commit, even with one of no events.
        """
        state = self._state()
        at = time.time() if at is None else at
        empty = [f.name for f in events.schema.fields if isinstance(f.dataType, T.NullType)]
        numbered = _numbered(events.drop(*empty), state["next"], at)
        folder = f"commit-{state['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        numbered.write.parquet(f"{self.root}/_staging/{folder}")
        schema = numbered.schema
        stored = self.spark.read.schema(schema).parquet(f"{self.root}/_staging/{folder}").agg(F.max("_seq").alias("last"), F.count(F.lit(1)).alias("n")).first()
        if stored["n"] or note:
            commit = {"folder": f"data/{folder}", "schema": schema.json(), "rows": stored["n"], "empty": empty, "texts": texts or {}, "note": note, "made": made}
            self._commit(state, [commit], (stored["last"] or state["next"] - 1) + 1)
        else:
            fs, path = self._fs(f"{self.root}/_staging/{folder}")
            fs.delete(path, True)
        return stored["n"]

    def texts(self) -> dict[str, list[str]]:
        """By column of expression text, the distinct expressions ever stored."""
        out: dict[str, dict[str, None]] = {}
        for c in self._state()["commits"]:
            for column, found in c["texts"].items():
                out.setdefault(column, {}).update(dict.fromkeys(found))
        return {c: list(t) for c, t in out.items()}

    def made(self) -> int:
        """How many keys were generated so far."""
        return sum(c["made"] for c in self._state()["commits"])

    def note(self) -> dict:
        """The last commit's note."""
        return next((c["note"] for c in reversed(self._state()["commits"]) if c["note"]), {})

    def events(self) -> DataFrame:
        """All committed events."""
        commits = self._state()["commits"]
        if not commits:
            return self.spark.createDataFrame([], EMPTY)
        folders: dict[str, list[str]] = {}
        for c in commits:
            folders.setdefault(c["schema"], []).append(f"{self.root}/{c['folder']}")
        parts = [(T.StructType.fromJson(json.loads(s)), paths) for s, paths in folders.items()]
        kinds: dict[str, list[T.DataType]] = {}
        spelling: dict[str, str] = {}
        for schema, _ in parts:
            for f in schema.fields:
                spelling.setdefault(f.name.lower(), f.name)
                kinds.setdefault(f.name.lower(), []).append(f.dataType)
        for c in commits:  # columns that so far held nothing
            for n in c["empty"]:
                spelling.setdefault(n.lower(), n)
                kinds.setdefault(n.lower(), [T.StringType()])
        wide = {n: _unified(k) for n, k in kinds.items()}
        out = None
        for schema, paths in parts:
            have = {f.name.lower(): f for f in schema.fields}
            columns = [F.col(f"`{have[n].name}`").cast(k).alias(spelling[n]) if n in have else F.lit(None).cast(k).alias(spelling[n]) for n, k in wide.items()]
            df = self.spark.read.schema(schema).parquet(*paths).select(*columns)
            out = df if out is None else out.union(df)
        return out

    def rows(self, as_of: float | None = None) -> DataFrame:
        """The current rows, or those at a time."""
        until = F.col("_ts") <= as_of if as_of is not None else None
        return latest(self.events(), "_key", ["_seq"], until, "_op")

    def compact(self) -> None:
        """Rewrite the commits as one for each set of column types; history stays."""
        state = self._state()
        schemas = {c["schema"] for c in state["commits"]}
        if len(state["commits"]) <= len(schemas):
            return
        merged = []
        for n, s in enumerate(sorted(schemas)):
            own = [c for c in state["commits"] if c["schema"] == s]
            folder = f"merged/commit-{state['version'] + 1:012d}-{n:04d}-{uuid.uuid4().hex[:8]}"
            self.spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(*[f"{self.root}/{c['folder']}" for c in own]).write.parquet(f"{self.root}/{folder}")
            texts: dict[str, dict[str, None]] = {}
            for c in own:
                for column, found in c["texts"].items():
                    texts.setdefault(column, {}).update(dict.fromkeys(found))
            merged.append({"folder": folder, "schema": s, "rows": sum(c["rows"] for c in own), "empty": sorted({e for c in own for e in c["empty"]}), "texts": {k: list(v) for k, v in texts.items()}, "note": None, "made": sum(c["made"] for c in own)})
        merged[-1]["note"] = self.note() or None
        self._put(state["version"] + 1, {"full": True, "next": state["next"], "commits": merged})
        for c in state["commits"]:
            fs, path = self._fs(f"{self.root}/{c['folder']}")
            fs.delete(path, True)
        for v in self._versions():
            if v <= state["version"]:
                fs, path = self._fs(f"{self.root}/_log/{v:012d}.json")
                fs.delete(path, False)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name, without regard to case; columns of different types become of one that holds both."""
    left, right = ({f.name.lower(): f for f in x.schema.fields} for x in (a, b))
    names = {n: (left.get(n) or right[n]).name for n in [*left, *right]}
    kinds = {n: _unified([s[n].dataType for s in (left, right) if n in s]) for n in names}

    def shaped(df: DataFrame, have: dict[str, T.StructField]) -> DataFrame:
        return df.select(*[(F.col(f"`{have[n].name}`") if n in have else F.lit(None)).cast(k).alias(names[n]) for n, k in kinds.items()])

    return shaped(a, left).union(shaped(b, right))


class MemoryLog(ChangeLog):
    """A change log that lives in the executors' memory and goes with the session."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, "", name)
        self.drop()

    def exists(self) -> bool:
        return True

    def create(self) -> None:
        pass

    def drop(self) -> None:
        for df in getattr(self, "held", []):
            df.unpersist()
        self.held: list[DataFrame] = []
        self.next, self._texts, self._note, self._made = 1, {}, {}, 0

    def head(self) -> int:
        return self.next - 1

    def commits(self) -> list[str]:
        return [str(k) for k in range(len(self.held))]

    def append(self, events: DataFrame, at: float | None = None, texts: dict[str, list[str]] | None = None, note: dict | None = None, made: int = 0) -> int:
        at = time.time() if at is None else at
        batch = _numbered(events, self.next, at).persist()
        last, n = batch.agg(F.max("_seq"), F.count(F.lit(1))).first()
        if n:
            self.held.append(batch)
            self.next = last + 1
        self._note, self._made = note or self._note, self._made + made
        for c, found in (texts or {}).items():
            self._texts[c] = [*self._texts.get(c, []), *found]
        return n

    def made(self) -> int:
        return self._made

    def texts(self) -> dict[str, list[str]]:
        return {c: list(dict.fromkeys(t)) for c, t in self._texts.items()}

    def note(self) -> dict:
        return self._note

    def events(self) -> DataFrame:
        out = self.spark.createDataFrame([], EMPTY)
        for batch in self.held:
            out = union(out, batch)
        return out

    def compact(self) -> None:
        if len(self.held) > 1:
            merged = self.events().persist()
            merged.count()
            for df in self.held:
                df.unpersist()
            self.held = [merged]
