"""A Python data source over recorded pages: forward or newest-first, until the range is covered.

    spark.dataSource.register(PagedSource)
    spark.read.format("pages").option("path", folder).option("start", 0).option("stop", 10).load()

Each host's folder is one partition; its pages are JSON files {"rows": [{"at": .., "payload": ..}], "next": name or null}.
Reading stops at a short page or without a next one, and fails where a cursor doesn't advance.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 500, 502, 503, 504)


class TransientError(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def retry(call: Callable[[], dict], attempts: int = 4, wait: float = 0.5, longest: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's answer; transient failures are tried again after doubling waits."""
    for attempt in range(attempts):
        try:
            return call()
        except TransientError as error:
            if error.status not in RETRIED or attempt == attempts - 1:
                raise
            sleep(min(longest, wait * 2**attempt))
    raise AssertionError("unreachable")


class Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.start, self.stop = options["path"], int(options["start"]), int(options["stop"])

    def partitions(self) -> list[Folder]:
        return [Folder(os.path.join(self.path, d)) for d in sorted(os.listdir(self.path))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        page, seen = "first", set()
        host = os.path.basename(partition.path)
        while page:
            if page in seen:
                raise ValueError(f"the cursor of {host} does not advance at {page}")
            seen.add(page)

            def load(name: str = page) -> dict:
                with open(os.path.join(partition.path, f"{name}.json")) as file:
                    return json.load(file)

            answer = retry(load)
            for row in answer["rows"]:
                if self.start <= row["at"] < self.stop:
                    yield host, row["at"], json.dumps(row["payload"])
            page = answer.get("next") if answer["rows"] else None


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "host string, at bigint, payload string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
