"""Keyed tables with commits: a Python data source sink, upserts by it, and reads of what is committed.

    upsert(spark, path, new, keys=["symbol", "ts"], compared=["close"], batch="run-17")
    read(spark, path)

Rows lie in buckets by a hash of their keys. Each task writes Parquet files of its own, one per
bucket, and hands their names to the driver; the commit is one small file that names the files of the
next version. So files of failed, repeated or killed tasks are never read, a version is seen whole or not
at all, and a batch that is committed already changes nothing when it is run again. An upsert reads and
rewrites the buckets that its rows fall into only. A table has one writer at a time, as a collection run has.

Paths are local or URIs of a store that pyarrow opens; reads go through Spark's Parquet scan.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from marketweave.operators.merge import merge

#: Buckets of a new table.
BUCKETS = 64
#: Columns that a write carries beside the table's own.
BUCKET, ACTION = "__bucket", "action"
ACTIONS = ("inserted", "updated", "skipped", "kept")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Version:
    """What a commit says: the files of each bucket, and what its batch did."""

    number: int = 0
    batch: str = ""
    buckets: int = BUCKETS
    schema: str | None = None
    files: dict[str, list[str]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


def _commits(path: str) -> list[tuple[int, str, str]]:
    """(number, batch, file) of all commits, oldest first."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    named = (re.fullmatch(r"(\d{12})-(.*)\.json", x.base_name) for x in found)
    return sorted((int(m[1]), m[2], f"{root}/commits/{m[0]}") for m in named if m)


def version(path: str, batch: str | None = None) -> Version | None:
    """The table's latest version, or the one that the batch has committed."""
    told = [x for x in _commits(path) if batch is None or x[1] == batch]
    if not told:
        return None
    with opened(path)[0].open_input_stream(told[-1][2]) as stream:
        return Version(**json.loads(stream.read()))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]
    counts: dict[str, int]


class TableWriter(DataSourceArrowWriter):
    """Writes the buckets of a batch; what it commits replaces these buckets."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.batch, self.buckets = options["path"], options["batch"], int(options["buckets"])
        self.touched = None if options.get("touched") is None else json.loads(options["touched"])
        self.table_schema = StructType([f for f in schema if f.name not in (BUCKET, ACTION)]).json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for each run of rows of a bucket; rows come ordered by bucket."""
        store, root = opened(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        files, counts = [], dict.fromkeys(ACTIONS, 0)
        now, writer = None, None
        for batch in iterator:
            for action, n in zip(*[x.to_pylist() for x in batch.column(ACTION).value_counts().flatten()], strict=True):
                counts[action] += n
            rows = pa.Table.from_batches([batch]).drop_columns([BUCKET, ACTION])
            for bucket in pc.unique(batch.column(BUCKET)).to_pylist():
                if bucket != now:
                    if writer:
                        writer.close()
                    now, name = bucket, f"{bucket:05d}-{uuid.uuid4().hex}.parquet"
                    files.append((bucket, name))
                    writer = pq.ParquetWriter(f"{root}/data/{name}", rows.schema, filesystem=store)
                writer.write_table(rows.filter(pc.equal(batch.column(BUCKET), bucket)))
        if writer:
            writer.close()
        return Written(files, counts)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if version(self.path, self.batch) is not None:
            self._remove(done)
            return
        last = version(self.path) or Version()
        gone = set(last.files if self.touched is None else map(str, self.touched))
        files = {b: names for b, names in last.files.items() if b not in gone}
        for m in done:
            for bucket, name in m.files:
                files.setdefault(str(bucket), []).append(name)
        counts = {a: sum(m.counts[a] for m in done) for a in ACTIONS}
        told = Version(last.number + 1, self.batch, self.buckets, self.table_schema, files, counts)
        store, root = opened(self.path)
        store.create_dir(f"{root}/commits", recursive=True)
        half, whole = f"{root}/commits/.{uuid.uuid4().hex}", f"{root}/commits/{told.number:012d}-{self.batch}.json"
        with store.open_output_stream(half) as stream:
            stream.write(json.dumps(vars(told)).encode())
        store.move(half, whole)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([m for m in messages if m is not None])

    def _remove(self, messages: list[Written]) -> None:
        store, root = opened(self.path)
        for m in messages:
            for _, name in m.files:
                store.delete_file(f"{root}/data/{name}")


class CommittedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options, schema)


def read(spark: SparkSession, path: str, buckets: list[int] | None = None, at: Version | None = None) -> DataFrame:
    """The rows of the latest version, or of `at`; of some buckets only where they are given."""
    now = at or version(path)
    if now is None:
        raise FileNotFoundError(f"no commit in {path}")
    schema = StructType.fromJson(json.loads(now.schema))
    files = [f"{path}/data/{name}" for b, names in sorted(now.files.items()) if buckets is None or int(b) in buckets for name in names]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _write(rows: DataFrame, path: str, batch: str, buckets: int, keys: list[str], touched: list[int] | None) -> None:
    if re.search(r"[/\s]", batch):
        raise ValueError(f"{batch!r} can't name a commit")
    rows.sparkSession.dataSource.register(CommittedTable)
    placed = rows.withColumn(BUCKET, _bucket(keys, buckets)).repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET)
    told = {} if touched is None else {"touched": json.dumps(touched)}
    placed.write.format("committed").mode("append").options(path=path, batch=batch, buckets=buckets, **told).save()


def replace(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], batch: str, buckets: int = BUCKETS) -> Version:
    """Makes rows the table's content; the version that the batch has committed."""
    if (done := version(path, batch)) is None:
        last = version(path)
        _write(rows.withColumn(ACTION, F.lit("inserted")), path, batch, last.buckets if last else buckets, keys, None)
        done = version(path, batch)
    return done


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], compared: list[str], batch: str, order: str | None = None, buckets: int = BUCKETS) -> Version:
    """Merges new rows into the table; the version that the batch has committed, with its counts of actions.

    Only buckets that new rows fall into are read and written. A batch that is committed already is left as it is.
    """
    if (done := version(path, batch)) is not None:
        return done
    last = version(path)
    if last is None:
        replace(spark, path, new.limit(0), keys, f"created-{uuid.uuid4().hex}", buckets)
        last = version(path)
    touched = [r[0] for r in new.select(_bucket(keys, last.buckets)).distinct().collect()]  # as many as buckets at most
    merged = merge(read(spark, path, touched, last), new, keys, compared, order)
    _write(merged, path, batch, last.buckets, keys, touched)
    return version(path, batch)


def vacuum(path: str, keep: int = 1) -> int:
    """Deletes files that none of the `keep` latest versions names; for times when nothing writes. The number of files deleted."""
    store, root = opened(path)
    named = set()
    for number, batch, _ in _commits(path)[-keep:]:
        told = version(path, batch)
        named |= {x for names in told.files.values() for x in names} if told.number == number else set()
    gone = [x.path for x in store.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if x.base_name not in named]
    for one in gone:
        store.delete_file(one)
    return len(gone)
