"""Stored tables: batches of rows in hash buckets of their keys, of which the latest row of each key counts.

A table is a bucketed Parquet table below its folder. A write appends a file to
each bucket that it has rows for and never touches older files. While it is at
work its batch is marked as pending, and readers leave pending batches out, so
they see whole batches and a write that fails is never seen. A batch holds a key
once. All batches of a key lie in one bucket, so a read finds the last of them
within its bucket, without a shuffle; files are sorted by the hash, as rows are to
find repeated keys, so neither writing nor reading sorts anew, and have Bloom
filters on it, so a row is looked up in one bucket by few pages.
``compact`` folds the files of each bucket that has more than one.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schema import ERROR, KEYS, SCHEMAS

BATCH, HASH = "_batch", "_hash"
#: Hash buckets of a new table: about as many as its gigabytes will be.
BUCKETS = 16
SECRETS = ("api_key", "authorization", "token", "password")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: on a cluster ``spark.checkpoint.dir`` must name it, in local mode one of our own will do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def latest(rows: DataFrame, keys: tuple[str, ...] | list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; rows that tie there are told apart by their other columns, so the choice is the same each time.

    For tables of narrow columns that can be ordered: the aggregate holds a row of
    each key, once. Tables with texts take ``newest``.
    """
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__row"))
    return best.select(*keys, "__row.*").select(*rows.columns)


def newest(rows: DataFrame, keys: tuple[str, ...] | list[str], batch: str) -> DataFrame:
    """The rows of each key in the last batch that has it; a batch has a key once.

    Only keys and batches are aggregated. Of the rows, the columns that are used
    later are shuffled, once; the others are not even read.
    """
    last = rows.groupBy(*keys).agg(F.max(batch).alias("__last")).select("__last", *[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(last, same & (F.col(batch) >= F.col("__last")), "left_semi")


def redact(params: F.Column) -> F.Column:
    """Run parameters without the values of secrets."""
    return F.transform_values(params, lambda k, v: F.when(F.lower(k).isin(*SECRETS) & (v != ""), "***").otherwise(v))


class Folder:
    """A folder of small named files, wherever Spark can write: names and what they hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(""))) if self.fs.exists(self._at("")) else []

    def get(self, name: str) -> str | None:
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write the file if there is none of the name, all of it or nothing; whether it was written."""
        beside = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(beside), True)
        stream.write(text.encode())
        stream.close()
        done = not self.fs.exists(self._at(name)) and self.fs.rename(self._at(beside), self._at(name))
        self.fs.delete(self._at(beside), False)
        return done

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), False)


class Merging(NamedTuple):
    """Rows to be stored as ``merge`` makes them: it is given them, with columns that the table does not have, where their bucket lies, and may hold them ``Store.beside`` what the table has."""

    rows: DataFrame
    merge: Callable[[DataFrame], DataFrame]


class Store:
    """The tables ``items``, ``runs``, ``responses`` and ``telemetry`` below one folder.

    ``buckets`` counts for tables that are not there yet; a table keeps its number.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _log(self, table: str, kind: str = "") -> Folder:
        """Files about a table: its ``layout``, and below ``pending`` and ``names`` its batches."""
        return Folder(self.spark, f"{self.folder}/{table}-log{'/' if kind else ''}{kind}")

    def _exists(self, table: str) -> bool:
        return self._log(table).get("layout") is not None

    def _table(self, table: str) -> str:
        """The session's name for the bucketed table, which is declared where it is not yet known."""
        path = self._path(table)
        name = f"{table}_{hashlib.md5(path.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            n, place = int(self._log(table).get("layout")), path.replace("'", "\\'")
            sorted_by = ", ".join((HASH, *KEYS[table]))
            blooms = ", ".join(f"'parquet.bloom.filter.enabled#{c}' = 'true'" for c in (HASH, *(k for k in KEYS[table] if k != "sample_idx")))
            self.spark.sql(f"CREATE TABLE {name} ({SCHEMAS[table]}, {BATCH} string, {HASH} bigint) USING parquet OPTIONS ({blooms}) CLUSTERED BY ({HASH}) SORTED BY ({sorted_by}) INTO {n} BUCKETS LOCATION '{place}'")
        return name

    def _bucketed(self, rows: DataFrame, table: str) -> DataFrame:
        """The rows of a batch, one of each key (the same one each time for the same rows; maps do not count in the choice), a task for each bucket; the writer sorts them."""
        plain = [f.name for f in rows.schema.fields if f.name != BATCH and not f.dataType.simpleString().startswith("map")]
        one = Window.partitionBy(HASH, *KEYS[table], BATCH).orderBy(F.xxhash64(*plain).desc())
        return self.dealt(rows, table).withColumn("__row", F.row_number().over(one)).where("__row = 1").drop("__row")

    def _append(self, rows: DataFrame, table: str) -> None:
        name = self._table(table)
        writer = rows.write.bucketBy(int(self._log(table).get("layout")), HASH).sortBy(HASH, *KEYS[table])
        writer.mode("append").saveAsTable(name)

    def upsert(self, table: str, rows: DataFrame | Merging, name: str | None = None) -> str:
        """Replace the rows of equal keys by these; other rows stay. Missing columns are null, columns of other names are dropped.

        Within one batch a repeated key keeps one of its rows. Parameters of runs
        are stored without secrets; a run without ``created_at`` is created now.
        A batch with a ``name`` is stored once: another of that name replaces it if
        it was not finished, and is left out if it was. Returns the batch's number.
        """
        rows, merge = rows if isinstance(rows, Merging) else (rows, None)
        schema = StructType.fromDDL(SCHEMAS[table])
        fit = lambda df, *more: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields], *more)
        whole = fit(rows, *([c for c in rows.columns if c not in schema.names] if merge else []))
        if table == "runs":
            whole = whole.withColumns({"params": redact(F.col("params")), "created_at": F.coalesce("created_at", F.current_timestamp())})
        self._log(table).put("layout", str(self.buckets))
        pending, names = self._log(table, "pending"), self._log(table, "names")
        if name is not None and (was := names.get(name)):
            return was
        batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        pending.put(batch, name or "")
        dealt = self._bucketed(whole.withColumns({BATCH: F.lit(batch), HASH: hash_of(table)}), table)
        self._append(fit(merge(dealt), BATCH, HASH) if merge else dealt, table)
        if name is not None:
            names.put(name, batch)
        pending.remove(batch)
        return batch

    def batch_named(self, table: str, name: str) -> str | None:
        """The number of a finished batch, by its name."""
        return self._log(table, "names").get(name)

    def stored(self, table: str) -> DataFrame:
        """All rows of finished batches, with their batch and the hash of their key."""
        name = self._table(table)
        self.spark.catalog.refreshTable(name)
        rows, unseen = self.spark.table(name), self._unfinished(table)
        return rows.where(~F.col(BATCH).isin(unseen)) if unseen else rows

    def _unfinished(self, table: str) -> list[str]:
        """Batches that are being written, or whose writer is gone; one that has its name already is finished."""
        pending, names = self._log(table, "pending"), self._log(table, "names")
        return [p for p in pending.names() if not ((n := pending.get(p)) and names.get(n) == p)]

    def read(self, table: str, until: str | None = None, before: str | None = None) -> DataFrame:
        """The table as it stands; no rows if nothing was written yet.

        ``until`` and ``before`` give it as it stood after or before a batch, as long
        as it was not compacted since.
        """
        return self.held(table, until, before).drop(BATCH, HASH)

    def held(self, table: str, until: str | None = None, before: str | None = None) -> DataFrame:
        """The same with the batch and the hash of each row, by which it lies in its bucket."""
        if not self._exists(table):
            return self.spark.createDataFrame([], f"{SCHEMAS[table]}, {BATCH} string, {HASH} bigint")
        rows = self.stored(table)
        if until is not None:
            rows = rows.where(F.col(BATCH) <= until)
        if before is not None:
            rows = rows.where(F.col(BATCH) < before)
        return _last_of_key(rows, table)

    def dealt(self, rows: DataFrame, table: str) -> DataFrame:
        """Rows that have a key of the table, with its hash, each in the task of its bucket."""
        n = int(self._log(table).get("layout") or self.buckets)
        return rows.withColumn(HASH, hash_of(table)).repartition(n, HASH)

    @staticmethod
    def beside(rows: DataFrame, table: str, held: DataFrame, name: str, columns: list[str], how: str = "left") -> DataFrame:
        """Rows that are ``dealt``, each with columns of the row that is ``held`` of its key as the struct ``name``; nothing that is stored is shuffled.

        They meet by the hash alone, which buckets are made of; that the keys are equal
        is said by two bounds, since Spark would shuffle both sides by keys it can join by.
        """
        keys = KEYS[table]
        there = held.select(F.col(HASH).alias("__hash"), *[F.col(k).alias(f"__{k}") for k in keys], F.struct(*columns).alias(name))
        same = reduce(lambda a, b: a & b, [F.col(k).between(F.col(f"__{k}"), F.col(f"__{k}")) for k in keys])
        return rows.join(there, (F.col(HASH) == F.col("__hash")) & same, how).drop("__hash", *[f"__{k}" for k in keys])

    def compact(self, table: str) -> list[int]:
        """Fold the files of each bucket that has more than one into one; returns those buckets. Run it when no writer is at work.

        The new files stand beside the old ones before these are removed, and a row
        that is in both counts once, so it may be broken off anywhere. Batches that
        were never finished are dropped.
        """
        if not self._exists(table):
            return []
        name, files = self._table(table), Folder(self.spark, self._path(table))
        by_bucket: dict[int, list[str]] = {}
        for f in files.names():
            if found := re.search(r"_(\d+)(?:\..*)?$", f):
                by_bucket.setdefault(int(found[1]), []).append(f)
        pending = self._log(table, "pending")
        left = self._unfinished(table)
        changed = {b: f for b, f in by_bucket.items() if len(f) > 1 or left}
        if changed:
            self.spark.catalog.refreshTable(name)
            kept = self.stored(table)
            paths = [f"{self._path(table)}/{f}" for old in changed.values() for f in old]
            rows = self.spark.read.schema(kept.schema).parquet(*paths).where(~F.col(BATCH).isin(left) if left else F.lit(True))
            n = int(self._log(table).get("layout"))
            last = _last_of_key(rows.repartition(n, HASH), table)
            self._append(last, table)
            for f in (f for old in changed.values() for f in old):
                files.remove(f)
            for b in left:
                pending.remove(b)
            self.spark.catalog.refreshTable(name)
        return sorted(changed)

    def runs(self) -> DataFrame:
        """The runs, oldest first."""
        return self.read("runs").orderBy("created_at", "run_id")

    def find(self, table: str, *key: object) -> DataFrame:
        """The row of one key, by its bucket, and within it by the files' filters and page indexes."""
        if not self._exists(table):
            return self.read(table)
        of = StructType.fromDDL(SCHEMAS[table])
        values = [F.lit(v).cast(of[k].dataType) for k, v in zip(KEYS[table], key, strict=True)]
        number = self.spark.range(1).select(F.xxhash64(*values).alias("h")).first().h
        same = reduce(lambda a, b: a & b, [F.col(k) == v if x is not None else F.col(k).isNull() for (k, v), x in zip(zip(KEYS[table], values, strict=True), key, strict=True)])
        return _last_of_key(self.stored(table).where((F.col(HASH) == number) & same), table).drop(BATCH, HASH)

    def telemetry_of(self, run_id: str, item_id: str, sample_idx: int) -> DataFrame:
        """The telemetry of one response."""
        return self.find("telemetry", run_id, item_id, sample_idx)


def hash_of(table: str) -> Column:
    return F.xxhash64(*KEYS[table])


def _last_of_key(rows: DataFrame, table: str) -> DataFrame:
    """The last row of each key; rows of one batch and key are alike, and one of them is taken."""
    last = Window.partitionBy(HASH, *KEYS[table]).orderBy(F.col(BATCH).desc())
    return rows.withColumn("__row", F.row_number().over(last)).where("__row = 1").drop("__row")


def done_items(responses: DataFrame) -> DataFrame:
    """``(run_id, item_id)`` of items without a failed sample."""
    failed = F.count(F.when(F.col("raw") == ERROR, 1))
    return responses.groupBy("run_id", "item_id").agg(failed.alias("failed")).where("failed = 0").drop("failed")


def todo(items: DataFrame, responses: DataFrame, run_id: str) -> DataFrame:
    """Items that this run has not done yet."""
    done = done_items(responses.where(F.col("run_id") == run_id)).select("item_id")
    return items.join(done, "item_id", "left_anti")
