"""A PEP 249 surface over an engine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from .engine import Engine
from .plans.lexer import QueryError

apilevel = "2.0"
paramstyle = "qmark"
threadsafety = 2


class Error(Exception):
    pass


class ProgrammingError(Error):
    pass


def connect(engine: Engine) -> Connection:
    return Connection(engine)


class Connection:
    def __init__(self, engine: Engine):
        self.engine = engine

    def cursor(self) -> Cursor:
        return Cursor(self)

    def execute(self, text: str, params: Sequence = ()) -> Cursor:
        return self.cursor().execute(text, params)

    def mappings(self, text: str, params: Sequence = ()) -> Iterator[dict]:
        """Rows as dictionaries of the attributes that are there."""
        for row in self.execute(text, params).rows:
            yield {k: v for k, v in row.asDict().items() if v is not None}

    def commit(self) -> None:
        if self.engine.pending is not None:
            self.engine.commit()

    def rollback(self) -> None:
        if self.engine.pending is not None:
            self.engine.rollback()

    def close(self) -> None:
        self.rollback()

    def __enter__(self) -> Connection:
        self.engine.begin()
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()


class Cursor:
    """Rows come a partition at a time, as they are fetched."""

    arraysize = 100

    def __init__(self, connection: Connection):
        self.connection = connection
        self.description: list[tuple] | None = None
        self.rows: Iterator = iter(())
        self.rowcount = -1

    def execute(self, text: str, params: Sequence = ()) -> Cursor:
        try:
            df = self.connection.engine.sql(text, list(params))
        except QueryError as e:
            raise ProgrammingError(str(e)) from e
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema.fields]
        self.rows = df.toLocalIterator()
        return self

    def executemany(self, text: str, many: Sequence[Sequence]) -> Cursor:
        for params in many:
            self.execute(text, params)
        return self

    def fetchone(self):
        row = next(self.rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [tuple(r) for _, r in zip(range(size or self.arraysize), self.rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self.rows]

    def __iter__(self):
        return map(tuple, self.rows)

    def close(self) -> None:
        self.rows = iter(())
