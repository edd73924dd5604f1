"""SQLite files as a Spark source (A8, A13): ``spark.read.format("sqlite")``.

Options: ``path`` (a file that executors can open), ``table`` or ``query``, and for tables
``key`` with ``partitions`` to read ranges of an integer key in parallel.
"""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TYPES = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}


class Range(InputPartition):
    def __init__(self, low: int | None = None, high: int | None = None):
        self.low, self.high = low, high


class Sqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def statement(self) -> str:
        if "query" in self.options:
            return self.options["query"]
        table = self.options["table"]
        if not table.replace("_", "").isalnum():
            raise ValueError(f"no table name: {table}")
        return f'SELECT * FROM "{table}"'

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            if "table" in self.options:
                self.statement()
                rows = con.execute(f"PRAGMA table_info(\"{self.options['table']}\")").fetchall()
                kind = lambda t: next((s for k, s in TYPES.items() if k in t.upper()), "binary" if not t else "double")
                return ", ".join(f"`{r[1]}` {kind(r[2])}" for r in rows)
            cursor = con.execute(f"SELECT * FROM ({self.statement()}) LIMIT 1")
            first = cursor.fetchone() or [None] * len(cursor.description)
            kinds = {int: "bigint", float: "double", bytes: "binary"}
            return ", ".join(f"`{d[0]}` {kinds.get(type(v), 'string')}" for d, v in zip(cursor.description, first, strict=True))

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options, self.statement(), schema)


class Reader(DataSourceReader):
    def __init__(self, options, statement: str, schema):
        self.options, self.statement, self.schema = dict(options), statement, schema

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", "1"))
        if "key" not in self.options or n < 2:
            return [Range()]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min(\"{self.options['key']}\"), max(\"{self.options['key']}\") FROM ({self.statement})").fetchone()
        if low is None:
            return [Range()]
        step = -(-(high - low + 1) // n)
        return [Range(lo, min(high, lo + step - 1)) for lo in range(low, high + 1, step)]

    def read(self, partition: Range):
        sql, args = self.statement, ()
        if partition.low is not None:
            sql, args = f"SELECT * FROM ({sql}) WHERE \"{self.options['key']}\" BETWEEN ? AND ?", (partition.low, partition.high)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            cursor = con.execute(sql, args)
            while rows := cursor.fetchmany(20_000):
                kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
                columns = [pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(zip(*rows, strict=True), self.schema.fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema.fields])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Sqlite)
