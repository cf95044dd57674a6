"""Committed tables, streams into them, held books and exact decimals."""

import glob
import os
import random
import subprocess
import sys
import textwrap
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from marketweave.functions import numeric
from marketweave.operators import depth
from marketweave.sources import committed
from marketweave.streaming import books, minutes, upserts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_and_replay(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(50)], "id long, name string, v double")
    first = committed.replace(spark, path, old, ["id"], "load", buckets=8)
    assert first.number == 1 and first.counts["inserted"] == 50 and rows(committed.read(spark, path)) == rows(old)
    new = spark.createDataFrame([(3, "n3", 3.0), (4, "x", 4.0), (4, "y", 4.0), (90, None, None)], "id long, name string, v double")
    done = committed.upsert(spark, path, new, ["id"], ["name", "v"], "one", order="name")
    assert (done.counts["inserted"], done.counts["updated"], done.counts["skipped"]) == (1, 1, 1)
    want = [r for r in rows(old) if r[0] != 4] + [(4, "y", 4.0), (90, None, None)]
    assert sorted(map(str, rows(committed.read(spark, path).where("id < 90")))) == sorted(map(str, [r for r in want if r[0] < 90]))
    files = sorted(os.listdir(f"{path}/data"))
    again = committed.upsert(spark, path, new.withColumn("v", F.lit(7.0)), ["id"], ["name", "v"], "one")
    assert again == done and sorted(os.listdir(f"{path}/data")) == files and committed.version(path).number == 2
    # only buckets of the new rows were written again; files of the version before stay for its readers until they are cleared
    assert sum(a != b for a, b in zip(first.files.values(), (done.files[k] for k in first.files), strict=True)) <= 3
    assert rows(committed.read(spark, path, at=first)) == rows(old)
    before = committed.read(spark, path).count()
    assert committed.vacuum(path) > 0 and committed.read(spark, path).count() == before == 51


def test_replace_with_fewer_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(20)
    committed.replace(spark, path, df, ["id"], "a")
    committed.replace(spark, path, df.where("id < 2"), ["id"], "b")
    assert rows(committed.read(spark, path)) == [(0,), (1,)]
    committed.replace(spark, path, df.limit(0), ["id"], "c")
    assert committed.read(spark, path).count() == 0 and committed.read(spark, path).columns == ["id"]
    with pytest.raises(ValueError, match="name a commit"):
        committed.replace(spark, path, df, ["id"], "a/b")
    with pytest.raises(FileNotFoundError):
        committed.read(spark, str(tmp_path / "none"))


def test_failed_write_leaves_no_version(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.replace(spark, path, spark.range(10), ["id"], "a")
    bad = spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        committed.replace(spark, path, bad, ["id"], "b")
    assert committed.version(path).batch == "a" and committed.read(spark, path).count() == 10


def test_task_that_dies_once(tmp_path):
    """A session that tries tasks again; every first attempt of the writing tasks is killed after it has written."""
    script = textwrap.dedent(f"""
        import os, sys
        from marketweave.session import build
        from marketweave.sources import committed
        from pyspark import TaskContext

        class Dying(committed.TableWriter):
            def write(self, iterator):
                done = super().write(iterator)
                if TaskContext.get().attemptNumber() == 0 and done.files:
                    os._exit(1)
                return done

        class Table(committed.CommittedTable):
            def writer(self, schema, overwrite):
                return Dying(self.options, schema)

        committed.CommittedTable = Table
        spark = build("dying", "local[2,4]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
        path = {str(tmp_path / "t")!r}
        done = committed.replace(spark, path, spark.range(1000), ["id"], "a")
        found = committed.read(spark, path)
        assert found.count() == 1000 and found.distinct().count() == 1000 and done.counts["inserted"] == 1000
        assert committed.vacuum(path) >= 2, "files of the attempts that died"
        assert found.count() == 1000
        print("all there")
    """)
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    told = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=240, cwd=tmp_path)
    assert "all there" in told.stdout, told.stderr[-2000:]


def test_stream_of_upserts_and_replay(spark, tmp_path):
    path, source, keys = str(tmp_path / "t"), str(tmp_path / "in"), ["k"]
    schema = "k long, v long, seq long"
    committed.replace(spark, path, spark.createDataFrame([(1, 10, 0)], schema), keys, "load")
    for n, part in enumerate([[(1, 11, 1), (2, 20, 1), (2, 21, 2)], [(2, 22, 3), (3, 30, 1)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/{n}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    run = lambda checkpoint, skip: upserts.upsert_stream(stream(), path, keys, ["v"], "seq", "s", str(tmp_path / checkpoint), skip).awaitTermination()
    run("c1", True)
    # what is stored stays, within a batch the last counts
    want = [(1, 10), (2, 21), (3, 30)]
    assert rows(committed.read(spark, path).select("k", "v")) == want
    number = committed.version(path).number
    run("c2", False)  # from the start under the same name: commits are known
    assert committed.version(path).number == number and rows(committed.read(spark, path).select("k", "v")) == want


def plain_hold(updates, step, age=None):
    """Slots by a loop, in microseconds."""
    out, by = [], {}
    for symbol, ts, value in updates:
        by.setdefault(symbol, []).append((ts, value))
    for symbol, seen in by.items():
        seen.sort()
        at, last = seen[0][0] // 1_000_000 * 1_000_000, seen[-1][0] // 1_000_000 * 1_000_000
        while at <= last:
            known = [x for x in seen if x[0] <= at]
            if known and (age is None or at - known[-1][0] <= age):
                out.append((symbol, at, known[-1][1], known[-1][0]))
            at += step
    return sorted(out)


@pytest.mark.parametrize(("step", "age"), [("1 second", None), ("1 second", "3 SECONDS"), ("7 SECONDS", None), ("1 MINUTE", None)])
def test_sample_and_hold_equals_a_loop(spark, step, age):
    rng = random.Random(2)
    day = 86_400_000_000
    start = 20_000 * day - 30_000_000  # over midnight, so over chunks
    updates = [(s, start + rng.randrange(0, 90_000_000), float(i)) for s in "ab" for i in range(12)]
    updates += [("a", updates[0][1], 99.0), ("c", start, 1.0), ("d", start + 5_000_000, 2.0), ("d", start + 2 * day // 1000, 3.0)]
    df = spark.createDataFrame(updates, "symbol string, at long, value double").select("symbol", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "value")
    got = depth.sample_and_hold(df, step, age)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    units = {"1 second": 1, "7 SECONDS": 7, "1 MINUTE": 60}[step] * 1_000_000
    assert rows(got.select("symbol", micros("ts"), "value", micros("seen"))) == plain_hold(updates, units, 3_000_000 if age else None)


def test_held_stream_over_batches(spark, tmp_path):
    schema, start = "symbol string, ts timestamp, value double", 1_700_000_000_000_000
    at = lambda s: start + int(s * 1_000_000)
    parts = [[("a", at(0.5), 1.0), ("a", at(2.2), 2.0), ("b", at(1), 5.0)], [("a", at(3.5), 3.0), ("a", at(3.9), 4.0)], [("b", at(40), 6.0)]]
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, "symbol string, at long, value double").select("symbol", F.timestamp_micros("at").alias("ts"), "value")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        for file in glob.glob(f"{tmp_path}/in/{n}/*.parquet"):
            os.utime(file, (1_000_000 + n, 1_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    with books.store(spark):
        got = minutes.drain(spark, books.held(stream, max_age=4), "append", str(tmp_path / "cp"))
    updates = [(s, t, v) for part in parts for s, t, v in part]
    want = [(s, t, v) for s, t, v, _ in plain_hold([*updates, ("a", at(60), 0.0), ("b", at(60), 0.0)], 1_000_000, 4_000_000) if t < at(40)]
    assert rows(got.select("symbol", F.unix_micros("ts"), "value")) == want


def test_held_stream_keeps_a_state_by_chunk(spark, tmp_path):
    """Updates across edges of chunks are held as in one, and no state gets all updates of a symbol."""
    edge, rng = 1_700_002_800, random.Random(3)
    assert edge % books.CHUNK == 0
    at = sorted({*(edge * 1_000_000 + rng.randrange(-30_000_000, 30_000_000) for _ in range(40)), edge * 1_000_000 + 3_600_000_000 - 2_500_000, edge * 1_000_000 + 3_601_700_000})
    updates = [(s, t, float(n)) for s in "ab" for n, t in enumerate(at)] + [("a", (edge + 7_199) * 1_000_000, 8.0), ("c", (edge + 7_203) * 1_000_000, 9.0)]
    df = spark.createDataFrame(updates, "symbol string, at long, value double").select("symbol", F.timestamp_micros("at").alias("ts"), "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("symbol string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    frame = books.held(stream, max_age=10)
    assert "symbol#" in (plan := frame._jdf.queryExecution().analyzed().toString()) and "chunk#" in plan.split("TransformWithState")[1].split("\n")[0]
    with books.store(spark):
        got = minutes.drain(spark, frame, "append", str(tmp_path / "cp"))
    # the last updates of a and c have no next one, and the watermark has not passed their ages
    want = [(s, t, v) for s, t, v, _ in plain_hold([*updates, *((s, (edge + 9_000) * 1_000_000, 0.0) for s in "abc")], 1_000_000, 10_000_000) if t < (edge + 7_199) * 1_000_000]
    assert rows(got.select("symbol", F.unix_micros("ts"), "value")) == want


def test_exact_mean_equals_decimals(spark):
    rng = random.Random(4)
    unit = Decimal(1).scaleb(-18)
    values = [(g, Decimal(rng.randrange(-(10 ** rng.randint(1, 35)), 10 ** rng.randint(1, 35))).scaleb(-18)) for g in range(40) for _ in range(rng.randint(1, 9))]
    values += [(100, unit), (100, Decimal(0)), (101, unit), (101, 2 * unit), (102, -unit), (102, Decimal(0)), (103, -unit), (103, -2 * unit), (104, None), (105, Decimal("99999999999999999.999999999999999999")), (106, Decimal("-0.5"))]
    values += [(200, Decimal("0.999999999999999999"))] * 3
    df = spark.createDataFrame(values, "g int, v decimal(38,18)").repartition(4)
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(numeric.exact_sum(F.col("v")).alias("t")).select("g", numeric.exact_mean(F.col("t")).alias("m")).collect()}
    for g in got:
        own = [v for x, v in values if x == g and v is not None]
        with localcontext() as context:
            context.prec = 60
            assert got[g] == ((sum(own) / len(own)).quantize(unit, rounding=ROUND_HALF_EVEN) if own else None), g


def test_exact_ratio_and_half_even(spark):
    df = spark.createDataFrame([(Decimal(1), Decimal(3)), (Decimal(1), Decimal(0)), (None, Decimal(1)), (Decimal("-2"), Decimal(3))], "a decimal(38,18), b decimal(38,18)")
    got = [r[0] for r in df.select(numeric.exact_ratio("a", "b")).collect()]
    assert got == [Decimal("0.333333333333333333"), None, None, Decimal("-0.666666666666666667")]
    ties = spark.createDataFrame([(Decimal("0.125"),), (Decimal("0.375"),), (Decimal("-0.125"),)], "v decimal(38,18)")
    assert [r[0] for r in ties.select(numeric.half_even(F.col("v"), 2)).collect()] == [Decimal("0.12"), Decimal("0.38"), Decimal("-0.12")]
