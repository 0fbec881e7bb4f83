"""A DB-API 2.0 face of a connection: cursors with `?` parameters. There are no transactions: commit does nothing, rollback is refused."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession

from lakeloom import api

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    pass


class DatabaseError(Error):
    pass


class NotSupportedError(DatabaseError):
    pass


class Cursor:
    arraysize = 1

    def __init__(self, con: api.Connection):
        self.con, self.description, self.rowcount = con, None, -1
        self._rows: Iterator[tuple] = iter(())

    def execute(self, text: str, parameters: Sequence = ()) -> Cursor:
        try:
            got = self.con.sql(text, list(parameters) if parameters else None)
        except Exception as e:
            raise DatabaseError(str(e)) from e
        self.description = [(n, t, None, None, None, None, None) for n, t in zip(got.columns, got.types, strict=True)] or None
        self._rows = got.stream() if self.description else iter(())
        return self

    def executemany(self, text: str, seq: Sequence[Sequence]) -> Cursor:
        for p in seq:
            self.execute(text, p)
        return self

    def fetchone(self) -> tuple | None:
        return next(self._rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [r for _, r in zip(range(size or self.arraysize), self._rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def __iter__(self) -> Iterator[tuple]:
        return self._rows

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    def __init__(self, spark: SparkSession | None = None):
        self.inner = api.connect(spark)

    def cursor(self) -> Cursor:
        return Cursor(self.inner)

    def commit(self) -> None:
        pass

    def rollback(self) -> None:
        raise NotSupportedError("there are no transactions")

    def close(self) -> None:
        pass

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def connect(spark: SparkSession | None = None) -> Connection:
    return Connection(spark)
