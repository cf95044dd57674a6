"""Recorded pages by time, as a Python data source: a range of time opens only the pages that it meets; a stream reads on, with an overlap.

    spark.dataSource.register(RangedSource)
    spark.read.format("ranged").option("path", folder).load().where("at >= 10 AND at < 20")
    spark.readStream.format("ranged").option("path", folder).option("overlap", 3).load()

A page is the folder `<path>/host=<host>/page=<from>-<to>` of JSON lines {"at": .., "payload": ..} with from <= at < to, as
`write_pages` leaves them. Filters on `at` and `host` are answered by the source where
spark.sql.python.filterPushdown.enabled is set; without it Spark applies them to all rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from marketweave.sources.committed import opened

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Pages of a task, about, and rows of a batch.
PAGES, ROWS = 64, 10_000
#: Beyond all times.
LEAST, MOST = -(1 << 62), 1 << 62
_ROW = pa.schema([("host", pa.string()), ("at", pa.int64()), ("payload", pa.string())])


def write_pages(rows: DataFrame, path: str, width: int) -> None:
    """Writes rows (host, at, payload) as pages of `width` units of time."""
    start = (F.col("at") - F.pmod("at", F.lit(width))).cast("long")
    page = F.concat(start, F.lit("-"), start + width)
    rows.select("host", page.alias("page"), F.to_json(F.struct("at", "payload")).alias("value")).repartition("host", "page").write.mode("append").partitionBy("host", "page").text(path)


@dataclass
class Span(InputPartition):
    """Pages of one host, and the times of them that are asked for."""

    host: str
    pages: list[str]
    low: int
    high: int


@dataclass
class Pages:
    """The pages in a folder, without opening any."""

    path: str
    hosts: set[str] | None = None
    known: list[tuple[str, int, int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        store, root = opened(self.path)
        for host in self._folders(store, root, "host"):
            name = host.rsplit("=", 1)[1]
            if self.hosts is None or name in self.hosts:
                for page in self._folders(store, host, "page"):
                    low, high = map(int, re.fullmatch(r".*=(-?\d+)-(-?\d+)", page).groups())
                    self.known.append((name, low, high, page))
        self.known.sort()

    @staticmethod
    def _folders(store: fs.FileSystem, path: str, key: str) -> list[str]:
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [x.path for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(f"{key}=")]

    def spans(self, low: int, high: int) -> list[Span]:
        out: list[Span] = []
        for host, first, end, page in self.known:
            if first < high and end > low:
                if not out or out[-1].host != host or len(out[-1].pages) >= PAGES:
                    out.append(Span(host, [], low, high))
                out[-1].pages.append(page)
        return out


def read_span(path: str, span: Span | None) -> Iterator[pa.RecordBatch]:
    """Rows of a span; where there is no span at all, Spark asks for none."""
    store, _ = opened(path)
    rows: list[dict] = []
    for page in span.pages if span else ():
        for file in sorted(store.get_file_info(fs.FileSelector(page)), key=lambda x: x.path):
            if file.base_name.startswith((".", "_")):
                continue
            with store.open_input_stream(file.path) as stream:
                for line in stream.read().splitlines():
                    row = json.loads(line)
                    if span.low <= row["at"] < span.high:
                        rows.append({"host": span.host, "at": row["at"], "payload": row["payload"]})
                    if len(rows) >= ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                        rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


class RangedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.low, self.high, self.hosts = options["path"], LEAST, MOST, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on at and host; the others stay with Spark."""
        for f in filters:
            on = getattr(f, "attribute", None)
            if on == ("at",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif on == ("at",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif on == ("at",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif on == ("host",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = own if self.hosts is None else self.hosts & own
            elif not (isinstance(f, IsNotNull) and on in (("at",), ("host",))):  # neither is ever null
                yield f

    def partitions(self) -> list[Span]:
        return Pages(self.path, self.hosts).spans(self.low, self.high)

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        yield from read_span(self.path, partition)


class RangedStream(DataSourceStreamReader):
    """Offsets are times: a batch reads from `overlap` before the end of the last one to the end of the latest page. Readers drop what they know by an upsert."""

    def __init__(self, options: dict[str, str]):
        self.path, self.overlap, self.start = options["path"], int(options.get("overlap", 0)), int(options.get("start", LEAST))

    def initialOffset(self) -> dict:
        return {"at": self.start}

    def latestOffset(self) -> dict:
        return {"at": max((high for _, _, high, _ in Pages(self.path).known), default=self.start)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        low = max(self.start, start["at"] - (self.overlap if start["at"] > self.start else 0))
        return Pages(self.path).spans(low, end["at"])

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        yield from read_span(self.path, partition)


class RangedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ranged"

    def schema(self) -> str:
        return "host string, at bigint, payload string"

    def reader(self, schema) -> RangedReader:
        return RangedReader(self.options)

    def streamReader(self, schema) -> RangedStream:
        return RangedStream(self.options)
