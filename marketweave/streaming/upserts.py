"""Streams into committed tables: a batch id is a commit, so what is replayed changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketweave.sources import committed


def upsert_stream(stream: DataFrame, path: str, keys: list[str], compared: list[str], order: str, name: str, checkpoint: str, skip_stored: bool = False) -> StreamingQuery:
    """Runs the stream for what is there now into the table at `path`; of rows with one key the last by `order` counts.

    With skip_stored, rows whose key the table has already are left out by an anti join: the fallback to a slower source, which only
    fills what the first one has missed. `name` and the batch's number name the commit.
    """
    spark = stream.sparkSession

    def put(rows: DataFrame, number: int) -> None:
        batch = f"{name}-{number}"
        if committed.version(path, batch) is not None:
            return
        if skip_stored and (now := committed.version(path)) is not None:
            rows = rows.join(committed.read(spark, path, at=now).select(*keys), keys, "left_anti")
        rest = F.struct(*[c for c in rows.columns if c not in keys])
        last = rows.groupBy(*keys).agg(F.max_by(rest, order).alias("__r")).select(*keys, "__r.*")
        committed.upsert(spark, path, last, keys, compared, batch)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
