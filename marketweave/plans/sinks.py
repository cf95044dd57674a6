"""Queries that write and stream: committed tables, pages by time, held books; and those of unknown JSON, large ranks and exact decimals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions import numeric as N
from marketweave.functions import timegrid, variants
from marketweave.operators import depth as D
from marketweave.operators.news import eligible
from marketweave.operators.news import window_start as news_window
from marketweave.operators.ranks import nearest_ranks
from marketweave.plans import market
from marketweave.plans.series import rounded
from marketweave.session import checkpoint_folder, cut, table
from marketweave.sources import committed, ranged
from marketweave.streaming import books, minutes, upserts

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"


# -- committed tables


def _upserted(spark: SparkSession, sf_dir: str) -> str:
    """A table of customers after an upsert, which is run twice, the second time with other rows under its name."""
    old, new = market.customers(spark, sf_dir)
    path, keys, compared = _folder(spark), ["c_custkey"], ["c_name", "c_acctbal"]
    committed.replace(spark, path, old, keys, "load")
    committed.upsert(spark, path, new, keys, compared, "changes")
    committed.upsert(spark, path, new.withColumn("c_acctbal", F.lit(0.0)), keys, compared, "changes")
    return path


@query(f"{market.NEW_CUSTOMERS} SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM merged")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(committed.read(spark, _upserted(spark, sf_dir)))


@query(f"""{market.NEW_CUSTOMERS} SELECT count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated,
count(*) FILTER (WHERE action = 'skipped') AS skipped, CAST(2 AS BIGINT) AS version FROM merged""")
def sink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last commit of the table says of its batch."""
    last = committed.version(_upserted(spark, sf_dir))
    return spark.createDataFrame([(last.counts["inserted"], last.counts["updated"], last.counts["skipped"], last.number)], "inserted long, updated long, skipped long, version long")


@query("""WITH e AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS minute, ts, value, event_id FROM events),
stored AS (SELECT symbol, minute, arg_max(value, ts) AS value, 'stream' AS via FROM e WHERE event_id % 2 = 0 GROUP BY symbol, minute),
polled AS (SELECT symbol, minute, arg_max(value, ts) AS value, 'poll' AS via FROM e GROUP BY symbol, minute)
SELECT symbol, minute, round(value, 6) AS value, via FROM stored UNION ALL SELECT symbol, minute, round(value, 6), via FROM polled p ANTI JOIN stored s ON p.symbol = s.symbol AND p.minute = s.minute""")
def fallback_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of a stream, and of a poll of all events for those that it has missed; the poll runs twice from the start."""
    events = table(spark, sf_dir, "events")
    shaped = lambda e, via: e.select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "ts", "value", F.lit(via).alias("via"))
    path, keys = _folder(spark), ["symbol", "minute"]
    first = shaped(events.where("event_id % 2 = 0"), "stream")
    committed.upsert(spark, path, first, keys, ["value"], "stream-0", order="ts")
    for _ in range(2):
        polled = shaped(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet"), "poll")
        upserts.upsert_stream(polled, path, keys, ["value"], "ts", "poll", _folder(spark), skip_stored=True).awaitTermination()
    return rounded(committed.read(spark, path).drop("ts"))


# -- pages by time


@contextmanager
def _pushdown(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ranged.PUSHDOWN)
    spark.conf.set(ranged.PUSHDOWN, "true")
    try:
        yield
    finally:
        spark.conf.set(ranged.PUSHDOWN, before)


def _event_pages(spark: SparkSession, sf_dir: str) -> str:
    """events as pages of a day by kind, in microseconds: milliseconds are rounded, so their bounds are not those of the times."""
    e = table(spark, sf_dir, "events")
    path = _folder(spark)
    ranged.write_pages(e.select(F.col("event_type").alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("string").alias("payload")), path, 86_400_000_000)
    spark.dataSource.register(ranged.RangedSource)
    return path


@query("""SELECT event_type AS host, epoch_ms(ts) AS at, CAST(event_id AS VARCHAR) AS payload FROM events
WHERE event_type IN ('view', 'purchase') AND ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-12 06:00:00'""")
def ranged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two kinds and two days, of pages of which the others stay closed."""
    with _pushdown(spark):
        pages = spark.read.format("ranged").option("path", _event_pages(spark, sf_dir)).load()
        low, high = 1_704_888_000_000_000, 1_705_039_200_000_000
        return cut(pages.where(F.col("host").isin("view", "purchase") & (F.col("at") >= low) & (F.col("at") < high)).withColumn("at", timegrid.rounded_millis(F.col("at"))))


@query("SELECT event_type AS host, epoch_ms(ts) AS at, CAST(event_id AS VARCHAR) AS payload FROM events WHERE ts >= TIMESTAMP '2024-01-05'")
def overlapping_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream that begins on a day, run again with an overlap of three days into one table: no row twice."""
    pages, path = _event_pages(spark, sf_dir), _folder(spark)
    checkpoint = _folder(spark)
    for _ in range(2):
        stream = spark.readStream.format("ranged").options(path=pages, overlap=3 * 86_400_000_000, start=1_704_412_800_000_000).load()
        upserts.upsert_stream(stream, path, ["host", "payload"], ["at"], "at", "pages", checkpoint).awaitTermination()
    return committed.read(spark, path).withColumn("at", timegrid.rounded_millis(F.col("at")))


@query("""WITH f AS (SELECT event_type AS feed, min(ts) AS activated, CASE WHEN event_type <> 'view' THEN date_trunc('day', min(ts)) + INTERVAL 20 DAY END AS watermark FROM events GROUP BY event_type),
w AS (SELECT feed, watermark IS NULL AS first_run, CASE WHEN watermark IS NULL THEN activated ELSE greatest(activated, watermark - INTERVAL 3 DAY) END AS start FROM f)
SELECT feed, start AS window_start, count(*) FILTER (WHERE e.ts < TIMESTAMP '2024-01-25' AND (first_run OR e.ts >= start)) AS eligible, count(*) FILTER (WHERE e.ts < TIMESTAMP '2024-01-25' AND e.ts >= start AND e.ts < start + INTERVAL 3 DAY) AS read_again
FROM w JOIN events e ON e.event_type = feed GROUP BY feed, start""")
def collection_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each feed where its next collection begins, the items that are eligible then, and those within the overlap."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("feed"), "ts")
    first = e.groupBy("feed").agg(F.min("ts").alias("activated"))
    mark = F.when(F.col("feed") != "view", F.date_trunc("day", "activated").cast("timestamp_ntz") + F.expr("INTERVAL 20 DAY"))
    feeds = first.select("feed", mark.alias("watermark"), news_window(F.col("activated"), mark).alias("window_start"))
    end = F.lit("2024-01-25").cast("timestamp_ntz")
    both = e.join(F.broadcast(feeds), "feed")  # a row per kind of event
    fits = eligible(F.col("ts"), F.col("window_start"), end, F.col("watermark").isNull())
    again = (F.col("ts") < end) & F.col("ts").between(F.col("window_start"), F.col("window_start") + F.expr("INTERVAL 3 DAY")) & (F.col("ts") < F.col("window_start") + F.expr("INTERVAL 3 DAY"))
    return both.groupBy("feed", "window_start").agg(F.count_if(fits).alias("eligible"), F.count_if(again).alias("read_again"))


# -- JSON of unknown shape, ranks of large groups

_SHAPES = """'["' || c_name || ' ", 5, {"text": [" ' || c_name || '-in", {"attributes": {"a": 1}, "text": "' || c_custkey || '"}]}, [[" ", "deep ' || c_custkey || '", null]], {"text": "no", "other": 1}, true]'"""
_PAYLOAD = f"CASE c_custkey % 5 WHEN 0 THEN '\" ' || c_name || '\"' WHEN 1 THEN '{{\"text\": \"' || c_name || '\"}}' WHEN 2 THEN '{{\"title\": \"x\"}}' WHEN 3 THEN NULL ELSE {_SHAPES} END"


@query(f"""WITH RECURSIVE n AS (
    SELECT c_custkey, []::BIGINT[] AS path, CAST({_PAYLOAD} AS JSON) AS j, 0 AS depth FROM customer
    UNION ALL
    SELECT c_custkey, CASE WHEN json_type(j) = 'ARRAY' THEN list_append(path, u.k) ELSE path END, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[' || u.k || ']') ELSE json_extract(j, '$.text') END, depth + 1
    FROM n, LATERAL (SELECT unnest(CASE WHEN json_type(j) = 'ARRAY' THEN range(CAST(json_array_length(j) AS BIGINT)) WHEN json_type(j) = 'OBJECT' AND len(list_filter(json_keys(j), lambda x: x NOT IN ('text', 'attributes'))) = 0 THEN [0::BIGINT] ELSE []::BIGINT[] END) AS k) u
    WHERE depth < 6
), s AS (SELECT c_custkey, path, trim(json_extract_string(j, '$')) AS t FROM n WHERE json_type(j) = 'VARCHAR')
SELECT c.c_custkey, coalesce(string_agg(t, '|' ORDER BY path) FILTER (WHERE t <> ''), '') AS texts FROM customer c LEFT JOIN s USING (c_custkey) GROUP BY c.c_custkey""")
def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in payloads of several shapes, in order."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(variants.texts(F.expr(_PAYLOAD)), "|").alias("texts"))


@query("""SELECT l_returnflag, share, CASE share WHEN 0.5 THEN a WHEN 0.95 THEN b ELSE c END AS value
FROM (SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS a, quantile_disc(l_extendedprice, 0.95) AS b, quantile_disc(l_extendedprice, 0.001) AS c FROM lineitem GROUP BY l_returnflag), (SELECT unnest([0.5, 0.95, 0.001]::DOUBLE[]) AS share)""")
def range_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ranks of a third of all lines each, from counts of ranges."""
    return nearest_ranks(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95, 0.001], ranked=1_000)


# -- books by the second

_HELD = """WITH u AS (SELECT event_type AS symbol, ts, value, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS next FROM events),
s AS (SELECT symbol, value, ts AS seen, next, unnest(generate_series(CASE WHEN ts = date_trunc('second', ts) THEN ts ELSE date_trunc('second', ts) + INTERVAL 1 SECOND END, ts + INTERVAL 10 SECOND, INTERVAL 1 SECOND)) AS ts FROM u)"""


@query(f"""{_HELD}, hi AS (SELECT event_type AS symbol, date_trunc('second', max(ts)) AS hi FROM events GROUP BY event_type)
SELECT s.symbol, s.ts, round(value, 6) AS value, seen FROM s JOIN hi ON s.symbol = hi.symbol WHERE (next IS NULL OR s.ts < next) AND s.ts <= hi""")
def held_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each second the latest event of its kind, while it is not older than ten seconds."""
    updates = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "value")
    return rounded(D.sample_and_hold(updates, max_age="10 SECONDS"))


@query(f"""{_HELD} SELECT symbol, ts, round(value, 6) AS value, seen FROM s
WHERE CASE WHEN next IS NULL THEN seen + INTERVAL 10 SECOND < (SELECT max(ts) FROM events) ELSE s.ts < next END""")
def stream_held_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As held_seconds, by a stream over the events file with state and timers."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    updates = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    with books.store(spark):
        done = minutes.drain(spark, books.held(updates), "append")
    return rounded(done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "seen")}))


# -- exact decimals

# whole units of the 18th place: doubles keep 16 digits of them
_UNITS = "CAST(round(l_extendedprice * 100) AS HUGEINT) * 10000000000000000 - CAST(l_partkey AS HUGEINT) * l_linenumber"
_EVEN = lambda a, b: f"CASE WHEN 2 * ({a} % {b}) > {b} OR (2 * ({a} % {b}) = {b} AND ({a} // {b}) % 2 = 1) THEN {a} // {b} + 1 ELSE {a} // {b} END"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # digits as declared: products and differences beyond 38 lose their last places
    tiny = ((F.col("l_partkey") * F.col("l_linenumber")).cast("decimal(19,0)") * F.lit("0.000000000000000001").cast("decimal(18,18)")).cast("decimal(37,18)")
    cents = (F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(37,18)")
    return lines.select("l_suppkey", "l_returnflag", (cents - tiny).alias("value"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_quantity").cast("bigint").alias("quantity"))


def _as_units(value):
    """A decimal of 18 places as the text of its whole units."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.", ""), "^(-?)0+(?=[0-9])", "$1")


@query(f"""WITH t AS (SELECT l_suppkey, l_returnflag, sum({_UNITS}) AS total, count(*)::HUGEINT AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, CAST(n AS BIGINT) AS n, CAST({_EVEN('total', 'n')} AS VARCHAR) AS mean_units FROM t""")
def exact_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of decimals to the 18th place, rounded half-even once."""
    total = _units(spark, sf_dir).groupBy("l_suppkey", "l_returnflag").agg(N.exact_sum(F.col("value")).alias("total"))
    return total.select("l_suppkey", "l_returnflag", F.col("total.n").alias("n"), _as_units(N.exact_mean(F.col("total"))).alias("mean_units"))


@query(f"""WITH t AS (SELECT l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::HUGEINT * 10000000000000000 AS a, sum(CAST(l_quantity AS BIGINT))::HUGEINT AS b FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CAST({_EVEN('a', 'b')} AS VARCHAR) AS price_units FROM t""")
def exact_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price a piece by supplier, to the 18th place."""
    sums = _units(spark, sf_dir).groupBy("l_suppkey").agg(F.sum("cents").cast("decimal(38,18)").alias("a"), F.sum("quantity").cast("decimal(38,18)").alias("b"))
    price = N.exact_ratio((F.col("a") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,18)"), F.col("b"))
    return sums.select("l_suppkey", _as_units(price).alias("price_units"))


@query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST({_EVEN('(CAST(l_partkey AS HUGEINT) * 125)', '10')} AS VARCHAR) AS eighths FROM lineitem""")
def half_even_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths to two places: every fourth is a tie."""
    lines = table(spark, sf_dir, "lineitem")
    eighth = (F.col("l_partkey").cast("decimal(20,0)") * F.lit("0.125").cast("decimal(3,3)")).cast("decimal(38,18)")
    return lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (N.half_even(eighth, 2) * 100).cast("bigint").cast("string").alias("eighths"))
