"""SQLite files as a data source: one partition a table, so tables of many files are read side by side."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Table(InputPartition):
    def __init__(self, path: str, kind: str, name: str):
        self.path, self.kind, self.name = path, kind, name


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], rows: bool, limit: int | None):
        self.paths, self.rows, self.limit = paths, rows, limit

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            with sqlite3.connect(f"file:{p}?mode=ro", uri=True) as c:
                q = "SELECT type, name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY type, name"
                out += [_Table(p, kind, name) for kind, name in c.execute(q)]
        return out

    def read(self, part: InputPartition) -> Iterator[tuple]:
        name = part.name.replace('"', '""')
        with sqlite3.connect(f"file:{part.path}?mode=ro", uri=True) as c:
            if not self.rows:
                sql = c.execute("SELECT coalesce(sql, '') FROM sqlite_master WHERE name = ?", (part.name,)).fetchone()[0]
                cols = [r[1] for r in c.execute(f'PRAGMA table_info("{name}")')]
                yield part.path, part.kind, part.name, sql, cols, c.execute(f'SELECT count(*) FROM "{name}"').fetchone()[0]
                return
            q = f'SELECT * FROM "{name}"' + (f" LIMIT {int(self.limit)}" if self.limit is not None else "")
            cur = c.execute(q)
            heads = [d[0] for d in cur.description]
            for i, r in enumerate(cur):
                cells = [f"[BLOB: {len(v)} bytes]" if isinstance(v, bytes) else v for v in r]
                yield part.path, part.name, i, json.dumps(dict(zip(heads, cells, strict=True)), ensure_ascii=False)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_file").option("path", ...)``; option ``rows=true`` reads rows as JSON, else the catalog."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def _rows(self) -> bool:
        return str(self.options.get("rows", "false")).lower() == "true"

    def schema(self) -> str:
        return "path string, name string, row_no int, row string" if self._rows() else "path string, type string, name string, sql string, columns array<string>, n_rows bigint"

    def reader(self, schema) -> DataSourceReader:
        limit = self.options.get("limit")
        return _Reader(self.options["path"].split(","), self._rows(), int(limit) if limit else None)


def register(spark) -> None:
    spark.dataSource.register(SqliteSource)
