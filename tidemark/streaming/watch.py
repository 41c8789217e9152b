"""WATCH: a table's changes, as they stand or as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Compiler, resolver
from ..operators.select import names, star_order
from ..plans import nodes as N
from ..plans.lexer import QueryError


def visible(events: DataFrame, condition: Column | None) -> DataFrame:
    """A filter holds for upserts; deletes are always shown."""
    return events if condition is None else events.filter((F.col("_op") == "delete") | condition)


def _shaped(events: DataFrame, st: N.Watch) -> DataFrame:
    compiler = Compiler(resolver(events))
    rows = visible(events, compiler.condition(st.query.where) if st.query.where is not None else None)
    meta = [F.col("_seq"), F.col("_op"), F.col("_key")]
    if st.query.star:
        return rows.select(*meta, *[F.col(f"`{c}`") for c in star_order(rows).columns])
    return rows.select(*meta, *[compiler.column(i.node).alias(h) for i, h in zip(st.query.items, names(st.query.items), strict=True)])


def replay(engine, st: N.Watch) -> DataFrame:
    """The changes committed so far: none SINCE NOW, the current rows as upserts SINCE BEGINNING."""
    log = engine.log(st.query.table)
    events = log.rows() if st.since == "BEGINNING" else log.events().limit(0)
    out = _shaped(events, st).orderBy("_seq")
    return out.limit(st.query.limit) if st.query.limit else out


def follow(engine, st: N.Watch) -> DataFrame:
    """A stream of the changes committed to a table; a checkpoint of its query resumes it.

    It reads the folder that commits are moved to: nothing that isn't committed, and nothing again after `compact`,
    which writes elsewhere.  A consumer that hasn't read a folder before it was compacted has lost it; see
    :func:`tidemark.streaming.exporters.lost`.
    """
    log = engine.log(st.query.table)
    schema = log.events().schema
    if any(isinstance(f.dataType, T.VariantType) for f in schema.fields):
        raise QueryError(f"{st.query.table} has columns of several types, which can't be followed")
    head = log.head() if st.since == "NOW" else 0
    fs, data = log._fs(f"{log.root}/data")
    fs.mkdirs(data)
    events = engine.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{log.root}/data")
    return _shaped(events.filter(F.col("_seq") > head), st)
