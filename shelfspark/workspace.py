"""Tables in a folder: reading with a declared schema, guarded replacement, upserts, verified writes."""

from __future__ import annotations

import logging
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators import history, tables

_log = logging.getLogger(__name__)
_announced: set[str] = set()


class Workspace:
    """Parquet tables under ``path``. Writes go to a new version of the table, then a pointer moves to it: readers never see half a table."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path
        if read_only and not self._fs.exists(self._path(self.path)):
            raise FileNotFoundError(self.path)
        if read_only and self.path not in _announced:  # once a process and folder
            _announced.add(self.path)
            _log.warning("reading the tables of %s as they are: nothing can be written", self.path)

    def _versions(self, name: str) -> list[str]:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return []
        own = [f.getPath().getName() for f in self._fs.listStatus(at)]
        done = [v for v in own if v.startswith("v") and self._fs.exists(self._path(f"{self.path}/{name}/{v}/_SUCCESS"))]
        return sorted(done)

    def location(self, name: str) -> str | None:
        """The newest finished version of a table, or a plain Parquet file or folder of its name."""
        if versions := self._versions(name):
            return f"{self.path}/{name}/{versions[-1]}"
        plain = f"{self.path}/{name}.parquet"
        return plain if self._fs.exists(self._path(plain)) else None

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """A table. With a schema: its columns in its order, null where the file has none; a column that the file has wins. A missing table is empty."""
        at = self.location(name)
        if at is None:
            if schema is None:
                raise FileNotFoundError(f"{self.path}/{name}")
            return self.spark.createDataFrame([], schema)
        return fill(self.spark.read.parquet(at), schema) if schema else self.spark.read.parquet(at)

    def replace(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        if self.read_only:
            raise PermissionError(f"{self.path} is read-only")
        last = self._versions(name)
        number = int(last[-1][1:9]) + 1 if last else 1
        at = f"{self.path}/{name}/v{number:08d}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy(*partition_by).parquet(at)
        return at

    def append(self, name: str, df: DataFrame, schema: T.StructType) -> str:
        return self.replace(name, self.read(name, schema).unionByName(fill(df, schema)))

    def upsert(self, name: str, updates: DataFrame, keys: list[str], rules: dict[str, str], schema: T.StructType) -> str:
        return self.replace(name, history.upsert(self.read(name, schema), updates, keys, rules))

    def replace_guarded(self, name: str, new: DataFrame, key: str, schema: T.StructType, as_of: str) -> str:
        """Snapshots replaced key by key; a key whose new rows are under half of a fresh snapshot keeps the old ones, as do keys with nothing new."""
        old = self.read(name, schema)
        n = fill(new, schema)
        count = lambda df, c: df.groupBy(key).agg(F.count(F.lit(1)).alias(c), F.max("scraped_at").alias(f"{c}_at"))
        hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("prior_at").cast("timestamp"))) / 3.6e9
        both = count(old, "prior").join(count(n, "new"), key, "full")
        verdict = history.snapshot_verdict(F.coalesce("prior", F.lit(0)), F.coalesce("new", F.lit(0)), hours)
        kept = both.select(key, verdict.alias("verdict"))
        stay = old.join(kept.filter("verdict = 'keep'"), key, "left_semi")
        come = n.join(kept.filter("verdict = 'replace'"), key, "left_semi")
        return self.replace(name, stay.unionByName(come))

    def delete(self, name: str, keys: DataFrame) -> str:
        """A new version of a table without the rows of ``keys``."""
        return self.replace(name, tables.delete_keys(self.read(name), keys))

    def replace_keys(self, name: str, new: DataFrame, keys: DataFrame, schema: T.StructType) -> str:
        """A new version in which the rows of ``keys`` are those of ``new``, even if none are left."""
        return self.replace(name, tables.replace_keys(self.read(name, schema), fill(new, schema), keys))

    def update_columns(self, name: str, updates: DataFrame, keys: list[str], columns: list[str]) -> str:
        return self.replace(name, tables.update_columns(self.read(name), updates, keys, columns))

    def views(self, schemas: dict[str, T.StructType] | None = None, prefix: str = "") -> list[str]:
        """Temporary views of all tables, of the declared columns where there are ``schemas``, and of a table that is declared but missing, empty."""
        names = sorted({*self.tables(), *(schemas or {})})
        for n in names:
            self.read(n, (schemas or {}).get(n)).createOrReplaceTempView(f"{prefix}{n}")
        return [f"{prefix}{n}" for n in names]

    def verified(self, name: str, df: DataFrame, check: Column) -> DataFrame:
        """Writes a table, reads it again, and raises ValueError if a row of it fails ``check``."""
        self.replace(name, df)
        out = self.read(name)
        bad = out.filter(~F.coalesce(check, F.lit(False))).limit(1).count()
        if bad:
            raise ValueError(f"{name} was written with rows that fail its check")
        return out

    def query(self, sql: str, **args) -> DataFrame:
        """SQL over tables named as {table}, with :parameters."""
        names = {n: self.read(n) for n in self.tables() if "{" + n + "}" in sql}
        return self.spark.sql(sql, args=args, **names)

    def tables(self) -> list[str]:
        at = self._path(self.path)
        return sorted({os.path.splitext(f.getPath().getName())[0] for f in self._fs.listStatus(at)}) if self._fs.exists(at) else []


def fill(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the schema's columns, typed nulls for those it lacks."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


class Cursor:
    """Rows of a query read once, a partition at a time: ``fetchone``, ``fetchall`` and iteration go on from where the last of them stopped."""

    def __init__(self, df: DataFrame):
        self.description = [(f.name, f.dataType.simpleString()) for f in df.schema]
        self._rows: Iterator = df.toLocalIterator()

    def __iter__(self) -> Iterator[tuple]:
        return (tuple(r) for r in self._rows)

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchall(self) -> list[tuple]:
        return list(self)

    def close(self) -> None:
        self._rows = iter(())


def one(df: DataFrame):
    """The only row; ValueError for none or several."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError(f"one row expected, {len(rows)} or more found")
    return rows[0]
