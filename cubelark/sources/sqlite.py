"""SQLite as a Python data source: every column a string, read in ranges of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 100_000


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """Options: path, table (by default the first one), limit. The file must be on every executor."""

    @classmethod
    def name(cls) -> str:
        return "cubelark_sqlite"

    def _table(self) -> str:
        with connect(self.options["path"]) as c:
            tables = [r[0] for r in c.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by rowid")]
        wanted = self.options.get("table") or (tables[0] if tables else None)
        if wanted not in tables:
            raise ValueError(f"no table {wanted!r}; there are {tables}")
        return wanted

    def schema(self) -> str:
        with connect(self.options["path"]) as c:
            names = [r[1] for r in c.execute(f"pragma table_info({quoted(self._table())})")]
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema) -> DataSourceReader:
        limit = self.options.get("limit")
        return SqliteReader(self.options["path"], self._table(), len(schema.fields), None if limit is None else int(limit))


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, width: int, limit: int | None):
        self.path, self.table, self.width, self.limit = path, table, width, limit

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as c:
            low, high = c.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        if self.limit is not None:  # one range, so that the limit is one
            return [Range(low, high + 1)]
        return [Range(a, min(a + ROWS, high + 1)) for a in range(low, high + 1, ROWS)]

    def read(self, partition: Range) -> Iterator[tuple]:
        limit = "" if self.limit is None else f" limit {self.limit}"
        with connect(self.path) as c:
            for row in c.execute(f"select * from {quoted(self.table)} where rowid >= ? and rowid < ? order by rowid{limit}", (partition.low, partition.high)):
                yield tuple(None if v is None else str(v) for v in row)
