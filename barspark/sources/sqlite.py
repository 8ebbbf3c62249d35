"""Bars in SQLite files: a data source with planned row ranges and pushed filters, a probe, and a writer.

A path is a file or a folder of files (*.db), on storage that all executors see. The driver plans ranges of row numbers and reads
nothing else; tasks open files read-only and query their range with the pushed filters. Only the columns of the given schema are read.
"""

from __future__ import annotations

import datetime as dt
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barspark.sources.scratch import place, put, view

#: The table, its columns and types.
TABLE = "kbars"
TEXTS = ("symbol", "asset_type", "timeframe")
NUMBERS = ("open", "high", "low", "close", "volume")
SCHEMA = "symbol string, asset_type string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
CREATE = f"""CREATE TABLE IF NOT EXISTS {TABLE} (symbol TEXT NOT NULL, asset_type TEXT NOT NULL, timeframe TEXT NOT NULL, ts TEXT NOT NULL, open REAL NOT NULL, high REAL NOT NULL,
 low REAL NOT NULL, close REAL NOT NULL, volume REAL NOT NULL DEFAULT 0, PRIMARY KEY (symbol, asset_type, timeframe, ts))"""
ROWS_PER_TASK = 250_000
#: Bars of a file that write_sqlite builds in memory, some 60 MB with its key.
ROWS_PER_FILE = 250_000


def opened(path: str) -> sqlite3.Connection:
    """A read-only connection: to the file, where it is mounted, else to its bytes in memory."""
    system, at = place(path)
    if isinstance(system, fs.LocalFileSystem):
        db = sqlite3.connect(f"file:{at}?mode=ro", uri=True)
    else:
        db = sqlite3.connect(":memory:")
        db.deserialize(view(path).to_pybytes())
    db.execute("PRAGMA query_only=ON")
    return db


def files(path: str) -> list[str]:
    system, at = place(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    scheme = path[: path.index(at)] if at in path else ""
    return sorted(scheme + f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".db"))


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.rows = int(options.get("rowsPerTask", ROWS_PER_TASK))
        self.clauses: list[str] = []
        self.values: list = []
        unknown = [f.name for f in schema.fields if f.name not in (*TEXTS, "ts", *NUMBERS)]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists of keys are answered here; bounds of ts only narrow what is read, as texts of times have several forms."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in TEXTS and isinstance(f, EqualTo):
                self._where(f"{name} = ?", f.value)
            elif name in TEXTS and isinstance(f, In):
                self._where(f"{name} IN ({', '.join('?' * len(f.value))})", *f.value)
            else:
                if name == "ts" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                    self._bounded(f)
                yield f

    def _where(self, clause: str, *values: object) -> None:
        self.clauses.append(clause)
        self.values.extend(values)

    def _bounded(self, f: Filter) -> None:
        # By whole days, and one more for offsets in the text.
        day = dt.date.fromisoformat(str(f.value)[:10])
        if not isinstance(f, LessThan | LessThanOrEqual):
            self._where("ts >= ?", (day - dt.timedelta(1)).isoformat())
        if not isinstance(f, GreaterThan | GreaterThanOrEqual):
            self._where("ts < ?", (day + dt.timedelta(2)).isoformat())

    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path):
            db = opened(path)
            first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {TABLE}").fetchone()
            db.close()
            if first is not None:
                out += [Range(path, a, min(a + self.rows - 1, last)) for a in range(first, last + 1, self.rows)]
        # Spark asks for one at least.
        return out or [Range("", 0, -1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        names = [f.name for f in self.schema.fields]
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.clauses])
        db = opened(part.path)
        kinds = to_arrow_schema(self.schema)
        try:
            found = db.execute(f"SELECT {', '.join(names) or '1'} FROM {TABLE} WHERE {where}", (part.first, part.last, *self.values))
            while rows := found.fetchmany(20_000):
                columns = [_checked(n, [r[k] for r in rows]) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(columns)], schema=kinds)
        finally:
            db.close()


def _checked(name: str, values: list) -> list:
    """Values of a column, if their storage classes are right; SQLite itself takes any."""
    want = (int, float) if name in NUMBERS else (str,)
    wrong = next((v for v in values if not isinstance(v, want)), want)
    if wrong is not want:
        raise ValueError(f"{name} is {'a number' if name in NUMBERS else 'a text'}, not {wrong!r}")
    if name != "ts":
        return [float(v) for v in values] if name in NUMBERS else values
    times = (dt.datetime.fromisoformat(v) for v in values)
    return [t if t.tzinfo is None else t.astimezone(dt.UTC).replace(tzinfo=None) for t in times]


class SqliteBars(DataSource):
    """Format `sqlite_bars`: option path, and rowsPerTask for the size of a range."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def sqlite_bars(spark: SparkSession, path: str, columns: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Bars of all files at path: of the named columns (all, if none are). Filters on keys and ts are pushed into the files.

    A value of the wrong storage class raises. A folder without files, or empty ones, give no rows; a path that is missing raises.
    """
    spark.dataSource.register(SqliteBars)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fields = dict(part.split(" ", 1) for part in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {fields[c]}" for c in columns or fields)
    return spark.read.format("sqlite_bars").schema(schema).option("rowsPerTask", str(rows_per_task)).load(path)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """path, readonly, schema_version, data_version, first_ts, last_ts, bars of each file, as read in tasks."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["path"]:
                db = opened(p)
                readonly = db.execute("PRAGMA query_only").fetchone()[0] == 1
                versions = [db.execute(f"PRAGMA {v}").fetchone()[0] for v in ("schema_version", "data_version")]
                out.append((p, readonly, *versions, *db.execute(f"SELECT min(ts), max(ts), count(*) FROM {TABLE}").fetchone()))
                db.close()
            yield pd.DataFrame(out, columns=["path", "readonly", "schema_version", "data_version", "first_ts", "last_ts", "bars"])

    paths = files(path)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return rows.mapInPandas(look, "path string, readonly boolean, schema_version long, data_version long, first_ts string, last_ts string, bars long")


def write_sqlite(bars: DataFrame, where: str, parts: int = 8, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Writes bars (the columns of SCHEMA) as files in a folder, the bars of a symbol and time frame in order; of equal keys one bar stays.

    parts tasks write files of at most rows_per_file bars, one after the other; each is built in memory and appears whole, so what a task holds has
    a bound whatever the number of bars. Bars without a key, time or price are left out. Returns the number of bars in the files.
    """
    keys = ["symbol", "asset_type", "timeframe", "ts"]
    insert = f"INSERT OR REPLACE INTO {TABLE} VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, file, db, held = TaskContext.get().partitionId(), 0, None, 0
        last: tuple | None = None

        def done() -> int:
            db.commit()
            n = db.execute(f"SELECT count(*) FROM {TABLE}").fetchone()[0]
            put(f"{where}/part-{part:05d}-{file:05d}.db", db.serialize())
            db.close()
            return n

        for batch in batches:
            times = [pd.Timestamp(t).isoformat() for t in batch["ts"]]
            rows = list(zip(*(batch[c] for c in TEXTS), times, *(map(float, batch[c]) for c in NUMBERS), strict=True))
            at = 0
            while at < len(rows):
                if db is not None and held >= rows_per_file and rows[at][:4] != last:
                    yield pd.DataFrame({"n": [done()]})
                    db, file = None, file + 1
                if db is None:
                    db, held = sqlite3.connect(":memory:"), 0
                    db.execute(CREATE)
                # A full file still takes the rows that repeat its last key, which replace one another.
                until = at + max(1, rows_per_file - held)
                db.executemany(insert, rows[at:until])
                held, last = held + len(rows[at:until]), rows[min(until, len(rows)) - 1][:4]
                at = until
        if db is None:
            db = sqlite3.connect(":memory:")
            db.execute(CREATE)
        yield pd.DataFrame({"n": [done()]})

    whole = bars.dropna(subset=[*keys, "open", "high", "low", "close"]).fillna({"volume": 0.0}).select(*keys, *NUMBERS)
    dealt = whole.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, *NUMBERS)
    return dealt.mapInPandas(build, "n long").agg(F.sum("n")).first()[0] or 0
