"""Streams of trades and book samples as minute tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketweave.operators.bars import bars
from marketweave.session import checkpoint_folder


def stream_bars(trades: DataFrame, step: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (symbol, ts, seq, price, buy), ts a timestamp; trades later than `lateness` are dropped."""
    return bars(trades.withWatermark("ts", lateness), step)


def drop_late(samples: DataFrame) -> DataFrame:
    """Samples (symbol, ts, value) of a stream without those that aren't after the last of their symbol and minute.

    The state of a key is the time of its last sample.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for batch in batches:
            kept = []
            for row in batch.itertuples(index=False):
                micros = row.ts.value // 1000
                if last is None or micros > last:
                    last = micros
                    kept.append(row)
            yield pd.DataFrame(kept, columns=batch.columns)
        if last is not None:
            state.update((last,))

    keyed = samples.withColumn("minute", F.date_trunc("minute", "ts"))
    schema = "symbol string, ts timestamp, value double, minute timestamp"
    return keyed.select("symbol", "ts", "value", "minute").groupBy("symbol", "minute").applyInPandasWithState(keep, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def drain(spark: SparkSession, stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All rows that the stream gives for what is there now, as Parquet in the shared checkpoint folder.

    Each batch writes a folder of its own, so one that is run again replaces what it wrote; in complete mode the last batch counts.
    """
    folder = f"{checkpoint_folder(spark)}/drained-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch-{0 if mode == 'complete' else batch}")

    where = checkpoint or f"{folder}/checkpoint"
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch-*")
