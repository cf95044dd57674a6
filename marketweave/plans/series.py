"""Queries over trades and bars made of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.operators import bars as B
from marketweave.operators import research as R
from marketweave.session import table

METRICS = ["trade_imbalance", "trade_intensity", "spread_expansion", "flow_price_mismatch"]

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def trades(spark: SparkSession, sf_dir: str, symbol: str | None = None) -> DataFrame:
    """events as trades: views and purchases are buys."""
    events = table(spark, sf_dir, "events")
    buy = F.when(F.col("event_type").isin("view", "purchase"), F.col("value")).otherwise(0.0)
    name = F.lit(symbol) if symbol else F.col("event_type")
    return events.select(name.alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), buy.alias("buy"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all trades as one symbol: contiguous, and all closed."""
    return B.bars(trades(spark, sf_dir, "ALL"), "1 hour").withColumn("closed", F.lit(True))


def _bars_sql(unit: str, symbol: str, bucket: str | None = None) -> str:
    bucket = bucket or f"date_trunc('{unit}', ts)"
    return f"""SELECT {symbol} AS symbol, {bucket} AS ts,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
        sum(value) AS volume, sum(CASE WHEN event_type IN ('view', 'purchase') THEN value ELSE 0 END) AS buy,
        count(*) AS trades, quantile_disc(value, 0.95) AS p95
    FROM events GROUP BY ALL"""


HOURLY = f"WITH bars AS (SELECT *, true AS closed FROM ({_bars_sql('hour', chr(39) + 'ALL' + chr(39))}))"
MINUTE = f"WITH bars AS ({_bars_sql('minute', 'event_type')})"
_BARS = "symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, round(buy, 6) AS buy, trades, round(p95, 6) AS p95"
_ALL = "'ALL'"
_FIVE = "time_bucket(INTERVAL 5 MINUTE, ts)"


@query(f"SELECT {_BARS} FROM ({_bars_sql('hour', 'event_type')})")
def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.bars(trades(spark, sf_dir), "1 hour"))


@query(f"SELECT {_BARS} FROM ({_bars_sql('day', _ALL)})")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.bars(trades(spark, sf_dir, "ALL"), "1 day"))


@query(f"SELECT {_BARS} FROM ({_bars_sql('minute', 'event_type')})")
def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.bars(trades(spark, sf_dir), "1 minute"))


@query(f"SELECT {_BARS} FROM ({_bars_sql('', 'event_type', _FIVE)})")
def five_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.bars(trades(spark, sf_dir), "5 minutes"))


_IMBALANCE = "CASE WHEN volume > 0 THEN (buy - (volume - buy)) / volume END"


def with_flow(bars: DataFrame) -> DataFrame:
    flow = B.imbalance(F.col("buy"), F.col("volume") - F.col("buy"))
    return bars.withColumn("trade_imbalance", flow).withColumn("flow_price_mismatch", B.flow_price_mismatch(F.col("trade_imbalance"), F.col("open"), F.col("close")))


@query(f"{HOURLY} SELECT symbol, ts, round({_IMBALANCE}, 6) AS trade_imbalance FROM bars")
def bar_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(with_flow(hourly(spark, sf_dir)).select("symbol", "ts", "trade_imbalance"))


_MISMATCH = "CASE WHEN open > 0 AND close > 0 AND flow * (close / open - 1) < 0 THEN flow * abs(close / open - 1) END"


@query(f"{HOURLY}, f AS (SELECT *, {_IMBALANCE} AS flow FROM bars) SELECT symbol, ts, round({_MISMATCH}, 6) AS flow_price_mismatch FROM f")
def flow_price_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(with_flow(hourly(spark, sf_dir)).select("symbol", "ts", "flow_price_mismatch"))


@query(f"{HOURLY} SELECT symbol, ts, round(CASE WHEN open <> 0 THEN (close - open) / open END, 6) AS change, round(CASE WHEN open <> 0 THEN (high - low) / open END, 6) AS amplitude FROM bars")
def candle_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.candle(hourly(spark, sf_dir)).select("symbol", "ts", "change", "amplitude"))


def _future_sql(unit: str) -> str:
    whole = " AND ".join(f"lead(ts, {k}) OVER w = ts + INTERVAL {k} {unit}" for k in range(1, 6))
    return f"SELECT *, CASE WHEN {whole} AND close > 0 THEN lead(close, 5) OVER w / close - 1 END AS future_return FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


@query(f"{HOURLY} SELECT symbol, ts, round(future_return, 6) AS future_return FROM ({_future_sql('HOUR')})")
def future_return_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.future_return(hourly(spark, sf_dir), "1 HOUR").select("symbol", "ts", "future_return"))


@query(f"{MINUTE} SELECT symbol, ts, round(future_return, 6) AS future_return FROM ({_future_sql('MINUTE')})")
def future_return_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.bars(trades(spark, sf_dir), "1 minute").withColumn("closed", F.lit(True))
    return rounded(B.future_return(bars, "1 MINUTE").select("symbol", "ts", "future_return"))


def _median_sql(source: str, column: str, valid: str, unit: str, name: str) -> str:
    return f"""SELECT * EXCLUDE (ok, brk, island, place, med), CASE WHEN ok AND place > 60 AND med > 0 THEN {column} / med END AS {name} FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY ts) AS place,
            median({column}) OVER (PARTITION BY symbol, island ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS med
        FROM (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts) AS island FROM (
            SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts <> lag(ts) OVER w + INTERVAL 1 {unit} OR NOT lag(ok) OVER w THEN 1 ELSE 0 END AS brk
            FROM (SELECT *, coalesce({valid}, false) AS ok FROM {source}) WINDOW w AS (PARTITION BY symbol ORDER BY ts))))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with all metrics and the label."""
    bars = with_flow(hourly(spark, sf_dir))
    bars = B.prior_median_ratio(bars, "volume", F.col("closed") & (F.col("volume") >= 0), "1 HOUR", "trade_intensity")
    bars = B.prior_median_ratio(bars, "p95", (F.col("p95") >= 0) & (F.col("trades") >= 2), "1 HOUR", "spread_expansion")
    return B.future_return(bars, "1 HOUR")


_INTENSITY = _median_sql("bars", "volume", "closed AND volume >= 0", "HOUR", "trade_intensity")
_EXPANSION = _median_sql("bars", "p95", "p95 >= 0 AND trades >= 2", "HOUR", "spread_expansion")


@query(f"{HOURLY} SELECT symbol, ts, round(trade_intensity, 6) AS trade_intensity FROM ({_INTENSITY})")
def prior_median_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir).select("symbol", "ts", "trade_intensity"))


@query(f"{HOURLY} SELECT symbol, ts, round(spread_expansion, 6) AS spread_expansion FROM ({_EXPANSION})")
def spread_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir).select("symbol", "ts", "spread_expansion"))


_STUDY = f"""{HOURLY}, flow AS (SELECT *, {_IMBALANCE} AS flow FROM bars),
metrics AS (SELECT f.*, {_MISMATCH.replace("flow *", "f.flow *")} AS mismatch FROM flow f),
labels AS (SELECT symbol, ts, future_return AS y FROM ({_future_sql("HOUR")})),
obs AS (
    SELECT symbol, 'trade_imbalance' AS metric, ts, flow AS x FROM metrics
    UNION ALL SELECT symbol, 'flow_price_mismatch', ts, mismatch FROM metrics
    UNION ALL SELECT symbol, 'trade_intensity', ts, trade_intensity FROM ({_INTENSITY})
    UNION ALL SELECT symbol, 'spread_expansion', ts, spread_expansion FROM ({_EXPANSION})
), whole AS (
    SELECT o.symbol, o.metric, o.ts, o.x, l.y FROM obs o JOIN labels l USING (symbol, ts) WHERE o.x IS NOT NULL AND l.y IS NOT NULL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY symbol, metric ORDER BY ts) AS rank, count(*) OVER (PARTITION BY symbol, metric) AS n FROM whole
), turned AS (
    SELECT *, min(CASE WHEN rank > floor(n * CAST(0.7 AS DOUBLE)) THEN ts END) OVER (PARTITION BY symbol, metric) AS turn FROM ranked
), parts AS (
    SELECT *, CASE WHEN rank > floor(n * CAST(0.7 AS DOUBLE)) THEN 'validation' WHEN turn IS NULL OR ts + INTERVAL 5 HOUR < turn THEN 'discovery' END AS part FROM turned
), cuts AS (
    SELECT symbol, metric, {", ".join(f"quantile_disc(x, {k / 10}) AS c{k}" for k in range(1, 10))} FROM parts WHERE part = 'discovery' GROUP BY symbol, metric
), found AS (
    SELECT p.symbol, p.metric, {" + ".join(f"(x >= c{k})::INT" for k in range(1, 10))} + 1 AS bucket, part, count(*) AS count, avg(y) AS mean_return, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS up_share
    FROM parts p JOIN cuts USING (symbol, metric) WHERE part IS NOT NULL GROUP BY ALL
), study AS (
    SELECT c.symbol, c.metric, b.bucket, q.part, coalesce(f.count, 0) AS count, f.mean_return, f.up_share
    FROM cuts c CROSS JOIN (SELECT unnest(range(1, 11)) AS bucket) b CROSS JOIN (SELECT unnest(['discovery', 'validation']) AS part) q
    LEFT JOIN found f ON f.symbol = c.symbol AND f.metric = c.metric AND f.bucket = b.bucket AND f.part = q.part
)"""


@query(f"{_STUDY} SELECT symbol, metric, bucket, part, count, round(mean_return, 6) AS mean_return, round(up_share, 6) AS up_share FROM study")
def decile_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.decile_study(R.observations(features(spark, sf_dir), METRICS, "future_return"), "5 HOUR"))


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN count(*) > 0 AND stddev_pop({a}) * stddev_pop({b}) <> 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


@query(f"""{_STUDY}, pairs AS (
    SELECT symbol, metric, bucket, max(mean_return) FILTER (WHERE part = 'discovery') AS d, max(mean_return) FILTER (WHERE part = 'validation') AS v FROM study GROUP BY ALL
), shape AS (
    SELECT symbol, metric, count(*) AS pairs, {_corr("d", "v")} AS agreement, {_corr("CAST(bucket AS DOUBLE)", "d")} AS trend_d, {_corr("CAST(bucket AS DOUBLE)", "v")} AS trend_v
    FROM pairs WHERE d IS NOT NULL AND v IS NOT NULL GROUP BY ALL
), spans AS (
    SELECT symbol, metric, count(*) AS samples, (epoch(max(ts)) - epoch(min(ts))) / 86400 AS days FROM whole GROUP BY ALL
), judged AS (
    SELECT s.*, coalesce(pairs, 0) AS pairs, agreement, trend_d, trend_v,
        coalesce(agreement >= 0.60 AND trend_d * trend_v > 0 AND abs(trend_d) >= 0.45 AND abs(trend_v) >= 0.45, false) AS stable
    FROM spans s LEFT JOIN shape USING (symbol, metric)
)
SELECT symbol, metric, samples, round(days, 6) AS days, pairs, round(agreement, 6) AS agreement, round(trend_d, 6) AS trend_d, round(trend_v, 6) AS trend_v,
    CASE WHEN samples < 1000 OR pairs < 8 THEN 'insufficient' WHEN stable AND samples >= 10000 AND days >= 7 THEN 'candidate' WHEN stable THEN 'watch' ELSE 'rejected' END AS level,
    CASE WHEN samples < 1000 THEN 'collecting' WHEN samples < 10000 THEN 'preliminary' WHEN samples < 30000 THEN 'usable' ELSE 'robust' END AS readiness
FROM judged""")  # fmt: skip
def metric_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = R.observations(features(spark, sf_dir), METRICS, "future_return")
    days = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400e6
    spans = obs.groupBy("symbol", "metric").agg(F.count("*").alias("samples"), days.alias("days"))
    return rounded(R.verdict(R.decile_study(obs, "5 HOUR"), spans))


_GRID = f"""{MINUTE}, bounds AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol),
slots AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS ts FROM bounds)"""


@query(f"""{_GRID}, gone AS (SELECT s.symbol, s.ts FROM slots s ANTI JOIN bars b ON s.symbol = b.symbol AND s.ts = b.ts),
islands AS (SELECT *, ts - INTERVAL 1 MINUTE * row_number() OVER (PARTITION BY symbol ORDER BY ts) AS island FROM gone)
SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 1 MINUTE AS stop, count(*) AS count FROM islands GROUP BY symbol, island""")
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.bars(trades(spark, sf_dir), "1 minute")
    return B.ranges(B.missing(bars, "1 MINUTE"), "1 MINUTE")


_DENSE = f"""{_GRID}, dense AS (
    SELECT s.symbol, s.ts, b.close, b.volume, b.ts IS NULL AS missing FROM slots s LEFT JOIN bars b ON s.symbol = b.symbol AND s.ts = b.ts
    JOIN bounds n ON n.symbol = s.symbol WHERE s.ts >= hi - INTERVAL 10079 MINUTE)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.dense(B.bars(trades(spark, sf_dir), "1 minute"), "1 MINUTE")


@query(f"{_DENSE} SELECT symbol, ts, round(close, 6) AS close, missing FROM dense")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_dense(spark, sf_dir).select("symbol", "ts", "close", "missing"))


@query(f"{_DENSE} SELECT symbol, ts, round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS mean FROM dense")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.trailing_mean(_dense(spark, sf_dir), ["close"], "mean").select("symbol", "ts", "mean"))


@query(f"""{_DENSE} SELECT symbol, ts, round((coalesce(sum(close) OVER w, 0) + coalesce(sum(volume) OVER w, 0)) / nullif(count(close) OVER w + count(volume) OVER w, 0), 6) AS mean
FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def trailing_pooled_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.trailing_mean(_dense(spark, sf_dir), ["close", "volume"], "mean").select("symbol", "ts", "mean"))


@query(f"{HOURLY} SELECT symbol, round(first(open ORDER BY ts), 6) AS open, round(last(close ORDER BY ts), 6) AS close, round(max(high), 6) AS high, round(min(low), 6) AS low, count(*) AS bars FROM bars GROUP BY symbol")
def range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.range_summary(hourly(spark, sf_dir)))
