"""Queries for audits, joins, funds, options, upserts, pages and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketweave.functions.timegrid import local_date
from marketweave.operators import depth as D
from marketweave.operators import funds as U
from marketweave.operators import joins as J
from marketweave.operators import merge as M
from marketweave.operators import options as O
from marketweave.operators import quality as Q
from marketweave.plans.series import rounded
from marketweave.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- audits


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as hourly candles, one per event: with repeated and absent hours."""
    e = table(spark, sf_dir, "events")
    price = F.col("value")
    return e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), price.alias("open"), price.alias("high"), price.alias("low"), (price - 100).alias("close"), price.alias("volume"), price.alias("buy"))


_TICKS = "WITH t AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, value AS o, value - 100 AS c FROM events)"
_INVALID = "(o <= 0 OR c <= 0 OR o < c OR o > c)"


@query(f"""{_TICKS}, bounds AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM t GROUP BY symbol),
slots AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM bounds),
gone AS (SELECT s.symbol, count(*) AS missing FROM slots s ANTI JOIN t ON s.symbol = t.symbol AND s.ts = t.ts GROUP BY s.symbol),
found AS (SELECT symbol, count(*) AS actual, count(*) - count(DISTINCT ts) AS duplicate, CAST(0 AS BIGINT) AS misaligned, count(*) FILTER (WHERE {_INVALID}) AS invalid FROM t GROUP BY symbol)
SELECT f.*, coalesce(g.missing, 0) AS missing, actual - duplicate + coalesce(g.missing, 0) AS expected,
    coalesce(g.missing, 0) = 0 AND duplicate = 0 AND misaligned = 0 AND invalid = 0 AS passed
FROM found f LEFT JOIN gone g ON f.symbol = g.symbol""")  # fmt: skip
def bar_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.audit(_ticks(spark, sf_dir), "1 HOUR", 3600)


@query(f"""{_TICKS}, r AS (SELECT symbol, unnest(list_filter([CASE WHEN o <= 0 THEN 'open_not_positive' END, CASE WHEN o <= 0 THEN 'high_not_positive' END,
    CASE WHEN o <= 0 THEN 'low_not_positive' END, CASE WHEN c <= 0 THEN 'close_not_positive' END, CASE WHEN o < c THEN 'high_below_close' END,
    CASE WHEN o > c THEN 'low_above_close' END], lambda x: x IS NOT NULL)) AS rule FROM t)
SELECT symbol, rule, count(*) AS count FROM r GROUP BY ALL""")
def ohlc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = _ticks(spark, sf_dir).select("symbol", F.explode(Q.broken(Q.ohlc_rules())).alias("rule"))
    return broken.groupBy("symbol", "rule").agg(F.count("*").alias("count"))


@query("SELECT user_id, event_type, count(*) AS count FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT event_id, event_type, ts, previous FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id % 97 * 1000000 + event_id) AS previous FROM events) WHERE ts < previous")
def sequence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in 97 runs, each of which begins anew."""
    e = table(spark, sf_dir, "events").withColumn("arrival", F.col("event_id") % 97 * 1_000_000 + F.col("event_id"))
    return Q.out_of_order(e, ["event_type"], "arrival", "ts").select("event_id", "event_type", "ts", "previous")


@query("""WITH s AS (SELECT event_type, ts, time_bucket(INTERVAL 8 HOUR, ts) AS start FROM events), m AS (SELECT *, CASE WHEN ts < start + INTERVAL 30 MINUTE THEN start END AS slot FROM s)
SELECT event_type, count(*) AS rows, count(slot) AS on_slot, count(DISTINCT slot) AS slots, count(slot) - count(DISTINCT slot) AS repeated FROM m GROUP BY event_type""")
def slot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = Q.slots(table(spark, sf_dir, "events"), "ts", "8 hours", "30 MINUTES")
    return placed.groupBy("event_type").agg(F.count("*").alias("rows"), F.count("slot").alias("on_slot"), F.count_distinct("slot").alias("slots"), (F.count("slot") - F.count_distinct("slot")).alias("repeated"))


@query("""SELECT event_id, event_type, ts FROM events WHERE event_type IN ('error', 'click', 'view')
ORDER BY list_position(['error', 'click', 'view'], event_type), ts, event_id LIMIT 200""")
def capped_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "click", "view"))
    issues = e.select(F.col("event_type").alias("category"), "ts", F.col("event_id").alias("id"))
    return Q.capped(issues, ["error", "click", "view"]).select(F.col("id").alias("event_id"), F.col("category").alias("event_type"), "ts")


@query("""SELECT d.source, CASE WHEN count(*) = count(l.toxic) THEN min(l.toxic) END::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def coverage_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return Q.trusted_start(joined, ["source"], "toxic").select("source", F.col("toxic").cast("bigint").alias("toxic"))


@query("""WITH r AS (SELECT user_id, max(ts) AS last, arg_max(event_type, ts) AS state FROM events GROUP BY user_id)
SELECT grade, count(*) AS users FROM (SELECT CASE WHEN state = 'error' OR epoch(TIMESTAMP '2024-01-31' - last) > 72 * 3600 THEN 'broken'
    WHEN epoch(TIMESTAMP '2024-01-31' - last) > 36 * 3600 OR state = 'click' THEN 'degraded' ELSE 'healthy' END AS grade FROM r) GROUP BY grade""")
def health_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", "ts").alias("state"))
    state = F.when(F.col("state") == "error", "failed").when(F.col("state") == "click", "warning").otherwise("passed")
    grade = Q.health(F.col("last"), state, F.col("last"), F.lit("2024-01-31").cast("timestamp"))
    return runs.groupBy(grade.alias("grade")).agg(F.count("*").alias("users"))


# -- joins


@query("""SELECT p.event_id, p.user_id, p.ts, v.event_id AS seen_id, round(v.value, 6) AS seen_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return rounded(J.asof(left, right, ["user_id"], "ts", "seen", ["seen_id", "seen_value"]))


@query("""SELECT e.event_id AS error_id, v.event_id, v.ts FROM events v JOIN events e ON v.ts > e.ts - INTERVAL 5 MINUTE AND v.ts <= e.ts WHERE v.event_type = 'view' AND e.event_type = 'error'""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("market", F.lit("ALL"))
    spans = e.where("event_type = 'error'").select("market", F.col("event_id").alias("error_id"), (F.col("ts") - F.expr("INTERVAL 5 MINUTES")).alias("start"), F.col("ts").alias("stop"))
    return J.interval(e.where("event_type = 'view'").select("market", "event_id", "ts"), spans, "market", "ts", "start", "stop", 300).select("error_id", "event_id", "ts")


@query("""SELECT a.o_custkey, a.o_orderkey AS "left", b.o_orderkey AS "right", date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE) AS gap
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE) BETWEEN 0 AND 14
    AND (date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE) > 0 OR a.o_orderkey < b.o_orderkey)""")
def range_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    pairs = J.band_pairs(orders, "o_custkey", "day", "o_orderkey", 14)
    return pairs.select("o_custkey", "left", "right", F.datediff("right_day", "left_day").cast("bigint").alias("gap"))


@query("""SELECT e.event_id AS run_id, count(*) AS minutes FROM events e JOIN events v ON v.ts > e.ts - INTERVAL 1 HOUR AND v.ts <= e.ts WHERE e.event_type = 'signup' AND v.event_type = 'click' GROUP BY ALL""")
def available_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("market", F.lit("ALL"))
    runs = e.where("event_type = 'signup'").select("market", F.col("event_id").alias("run_id"), (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("start"), F.col("ts").alias("stop"))
    return J.interval(e.where("event_type = 'click'").select("market", "ts"), runs, "market", "ts", "start", "stop", 3600).groupBy("run_id").agg(F.count("*").alias("minutes"))


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')""")
def semi_anti_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o.where("o_orderstatus = 'F'").select("o_custkey"), on, "left_semi").join(o.where("o_orderstatus = 'P'").select("o_custkey"), on, "left_anti")


@query("""SELECT o_custkey, o_orderkey, o_orderdate, round(o_totalprice, 6) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) = 1""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return rounded(J.latest(o, ["o_custkey"], [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()]))


@query("""SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return J.top(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).select("o_orderpriority", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT event_id AS id, ts, true AS has_more FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 60""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    return J.before(e, F.lit("2024-01-15").cast("timestamp_ntz"), 60)


@query("SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(100).limit(50))


@query("SELECT event_id, ts FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 60)")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(60).orderBy("ts", "event_id")


# -- sets and aggregates


@query("""SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS id, round(c_acctbal, 6) AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, round(s_acctbal, 6) FROM supplier
UNION ALL SELECT 'part', p_partkey, round(p_retailprice, 6) FROM part) ORDER BY value DESC, kind, id LIMIT 100""")
def union_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.round(v, 6).alias("value")) for t, k, v in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"), ("part", "p_partkey", "p_retailprice"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.col("value").desc(), "kind", "id").limit(100)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_custkey AS id FROM orders UNION SELECT s_suppkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial,
count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(DISTINCT o_custkey) AS customers, count(*) AS total, round(sum(o_totalprice), 2) AS value FROM orders""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count_if(status == "F").alias("finished"), F.count_if(status == "O").alias("open"), F.count_if(status == "P").alias("partial"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("total"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("""SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY source""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'success' WHEN bool_or(l_linestatus = 'F') THEN 'partial' ELSE 'failed' END AS status FROM lineitem GROUP BY l_orderkey""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    status = F.when(F.bool_and(done), "success").when(F.bool_or(done), "partial").otherwise("failed")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(status.alias("status"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, (1003 // (SELECT count(*) FROM nation) + CASE WHEN row_number() OVER (ORDER BY n_nationkey) <= 1003 % (SELECT count(*) FROM nation) THEN 1 ELSE 0 END)::BIGINT AS share FROM nation")
def proportional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.proportional(1003, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey"))


@query("SELECT (ts + INTERVAL 8 HOUR)::DATE AS day, count(*) AS events FROM events WHERE (ts + INTERVAL 8 HOUR)::DATE >= DATE '2024-01-10' GROUP BY day")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = local_date(F.col("ts"))
    return table(spark, sf_dir, "events").where(day >= F.lit("2024-01-10").cast("date")).groupBy(day.alias("day")).agg(F.count("*").alias("events"))


# -- funds

_DAILY = "WITH daily AS (SELECT o_orderstatus AS key, o_orderdate::DATE AS day, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("key"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("value"))


def _lagged(n: int) -> str:
    return f"ASOF LEFT JOIN daily d{n} ON d.key = d{n}.key AND d.day - {n} >= d{n}.day"


@query(f"{_DAILY} SELECT d.key, d.day, round(d.value, 4) AS value, round(d.value - d1.value, 4) AS change_1, round(d.value - d7.value, 4) AS change_7, round(d.value - d30.value, 4) AS change_30 FROM daily d {_lagged(1)} {_lagged(7)} {_lagged(30)}")
def asof_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.changes(_daily(spark, sf_dir)), 4)


@query(f"""{_DAILY} SELECT key, day, round(value, 4) AS value, round(sum(value) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS sum_5,
round(sum(value) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS sum_20 FROM daily""")
def rolling_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.cumulative(_daily(spark, sf_dir)), 4)


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    total = table(spark, sf_dir, "orders").groupBy(month.alias("day"), F.col("o_orderpriority").alias("name")).agg(F.sum("o_totalprice").alias("value"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.col("value").desc(), "name")).cast("bigint"))


@query("""WITH total AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, o_orderpriority AS name, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value DESC, name) AS rank FROM total),
n AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS n FROM (SELECT DISTINCT day FROM b) QUALIFY n <= 8), r AS (SELECT * FROM b JOIN n USING (day))
SELECT a.name, round(a.value, 4) AS value, a.rank, round(a.value - p.value, 4) AS change, round(a.value - w.value, 4) AS change_week, p.rank - a.rank AS rank_change, p.value IS NULL AS newly_entered, coalesce(abs(a.value - p.value) >= 10000, false) AS large_change
FROM r a LEFT JOIN r p ON p.name = a.name AND p.n = 2 LEFT JOIN r w ON w.name = a.name AND w.n = 8 WHERE a.n = 1""")
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.rank_changes(_balances(spark, sf_dir), "day"), 4)


@query("""WITH f AS (SELECT n_name AS name, (SELECT sum(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) - 15000 AS value FROM nation)
SELECT name, round(value, 4) AS value, CASE WHEN value IS NULL THEN 'missing' WHEN value > 0 THEN 'in' WHEN value < 0 THEN 'out' ELSE 'zero' END AS class, round(abs(value), 4) AS size FROM f""")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.sum("c_acctbal") - 15000).alias("value"))
    n = table(spark, sf_dir, "nation")
    flows = n.join(paid, n["n_nationkey"] == paid["c_nationkey"], "left").select(F.col("n_name").alias("name"), "value")
    return rounded(U.contributions(flows).orderBy(F.col("size").desc_nulls_last(), "name"), 4)


# -- options

_CHAIN = """WITH chain AS (SELECT date_trunc('month', l_shipdate)::DATE AS expiry, p_size::DOUBLE AS strike, CASE WHEN l_returnflag = 'R' THEN 'put' WHEN l_returnflag = 'A' THEN 'call' WHEN l_linenumber % 2 = 0 THEN 'put' ELSE 'call' END AS side,
l_quantity AS oi, CASE WHEN l_discount > 0 THEN l_discount END AS iv FROM lineitem JOIN part ON l_partkey = p_partkey), spot AS (SELECT expiry, avg(strike) AS x FROM chain GROUP BY expiry)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    side = F.when(F.col("l_returnflag") == "R", "put").when(F.col("l_returnflag") == "A", "call").when(F.col("l_linenumber") % 2 == 0, "put").otherwise("call")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    return joined.select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("expiry"), F.col("p_size").cast("double").alias("strike"), side.alias("side"), F.col("l_quantity").alias("oi"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("iv"))


def _spot(chain: DataFrame) -> DataFrame:
    return chain.groupBy("expiry").agg(F.avg("strike").alias("x"))


def _oi(keys: str) -> str:
    return f"SELECT {keys}, sum(oi) AS total_oi, coalesce(sum(oi) FILTER (WHERE side = 'call'), 0) AS call_oi, coalesce(sum(oi) FILTER (WHERE side = 'put'), 0) AS put_oi FROM chain GROUP BY {keys}"


@query(f"{_CHAIN} SELECT expiry, round(total_oi, 6) AS total_oi, round(call_oi, 6) AS call_oi, round(put_oi, 6) AS put_oi, round(put_oi / nullif(call_oi, 0), 6) AS put_call FROM ({_oi('expiry')})")
def oi_by_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.totals(_chain(spark, sf_dir), ["expiry"]))


_STRIKES = f"SELECT expiry, strike, call_oi, put_oi, call_oi + put_oi AS oi FROM ({_oi('expiry, strike')}) WHERE call_oi <> 0 OR put_oi <> 0"


@query(f"{_CHAIN} {_STRIKES}")
def oi_by_strike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.by_strike(_chain(spark, sf_dir), ["expiry"]))


@query(f"{_CHAIN} SELECT expiry, strike, oi FROM ({_STRIKES}) QUALIFY row_number() OVER (PARTITION BY expiry ORDER BY oi DESC, strike) = 1")
def peak_strike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.peak(O.by_strike(_chain(spark, sf_dir), ["expiry"]), ["expiry"]).select("expiry", "strike", "oi"))


@query(f"""{_CHAIN}, m AS (SELECT expiry, side, strike, avg(iv) AS iv FROM chain WHERE iv IS NOT NULL GROUP BY ALL),
b AS (SELECT expiry, side, x, arg_max(strike, strike) FILTER (WHERE strike < x) AS bs, arg_max(iv, strike) FILTER (WHERE strike < x) AS bi, arg_min(strike, strike) FILTER (WHERE strike >= x) AS s, arg_min(iv, strike) FILTER (WHERE strike >= x) AS i FROM m JOIN spot USING (expiry) GROUP BY ALL),
y AS (SELECT expiry, side, CASE WHEN bs IS NULL THEN i WHEN s IS NULL THEN bi ELSE bi + (i - bi) * (x - bs) / (s - bs) END AS y FROM b)
SELECT expiry, round(avg(y), 6) AS atm_iv FROM y GROUP BY expiry""")
def atm_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _chain(spark, sf_dir)
    at = _spot(chain).withColumn("side", F.explode(F.array(F.lit("call"), F.lit("put"))))
    line = O.interpolate(chain.select("expiry", "side", "strike", "iv"), at, ["expiry", "side"])
    return rounded(line.groupBy("expiry").agg(F.avg("y").alias("atm_iv")))


@query(f"""{_CHAIN}, t AS (SELECT max(expiry) - 365 + d AS target FROM chain, (SELECT unnest([30, 90]) AS d) GROUP BY d)
SELECT target, expiry FROM (SELECT DISTINCT expiry FROM chain) CROSS JOIN t QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(expiry - target), expiry) = 1""")
def nearest_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    expiries = _chain(spark, sf_dir).select("expiry", F.lit(1).alias("one")).distinct()
    targets = expiries.agg(F.max("expiry").alias("last")).select(F.lit(1).alias("one"), F.explode(F.array(F.date_add(F.date_sub("last", 365), 30), F.date_add(F.date_sub("last", 365), 90))).alias("target"))
    return O.nearest(expiries, targets, ["one"]).select("target", "expiry")


@query(f"""{_CHAIN}, m AS (SELECT expiry, strike, avg(iv) AS iv FROM chain WHERE iv IS NOT NULL GROUP BY ALL), p AS (SELECT expiry, strike, strike / x * 100 AS moneyness, iv FROM m JOIN spot USING (expiry) WHERE strike / x * 100 BETWEEN 70 AND 130),
r AS (SELECT *, row_number() OVER (PARTITION BY expiry ORDER BY strike) - 1 AS i, count(*) OVER (PARTITION BY expiry) AS n FROM p)
SELECT expiry, round(moneyness, 6) AS moneyness, round(iv, 6) AS iv FROM r WHERE n <= 20 OR len(list_filter(range(20), lambda k: floor(k * ((n - 1) / 19.0::DOUBLE) + 0.5) = i)) > 0""")
def skew_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _chain(spark, sf_dir)
    return rounded(O.skew(chain.select("expiry", "strike", "iv"), _spot(chain), ["expiry"]))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:20], lambda x: abs(x::DOUBLE)) AS q FROM embeddings),
d AS (SELECT vec_id, """ + ", ".join(f"list_sum(list_transform(range(1, {n + 1}), lambda i: (101 - i) * q[i])) AS b{n}, list_sum(list_transform(range(1, {n + 1}), lambda i: (100 + i) * q[i])) AS a{n}" for n in (5, 10, 20)) + """ FROM e)
SELECT vec_id, 100.5::DOUBLE AS mid, 1.0::DOUBLE AS spread, round(1.0 / 100.5 * 10000, 6)::DOUBLE AS spread_bps, """ + ", ".join(f"round(b{n}, 6) AS bid_depth_{n}, round(a{n}, 6) AS ask_depth_{n}, round((b{n} - a{n}) / (b{n} + a{n}), 6) AS imbalance_{n}" for n in (5, 10, 20)) + " FROM d")  # fmt: skip
def depth_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.slice("embedding", 1, 20)
    level = lambda price: lambda x, i: F.struct(price(i).cast("double").alias("price"), F.abs(x.cast("double")).alias("quantity"))
    books = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(size, level(lambda i: 100 - i)).alias("bids"), F.transform(size, level(lambda i: 101 + i)).alias("asks"))
    return rounded(D.features(books).drop("bids", "asks"))


# -- upserts

NEW_CUSTOMERS = """WITH new AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_custkey % 7 = 0),
merged AS (SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'kept' WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_name IS NOT DISTINCT FROM o.c_name AND n.c_acctbal IS NOT DISTINCT FROM o.c_acctbal THEN 'skipped' ELSE 'updated' END AS action,
coalesce(n.c_name, o.c_name) AS c_name, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal FROM new n FULL JOIN customer o ON n.c_custkey = o.c_custkey)"""


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as stored, and a batch of new and changed ones."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = old.where("c_custkey % 2 = 0").withColumn("c_acctbal", changed).unionByName(old.where("c_custkey % 7 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return old, new


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = customers(spark, sf_dir)
    return M.merge(old, new, ["c_custkey"], ["c_name", "c_acctbal"]), new


@query(f"{NEW_CUSTOMERS} SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal, action FROM merged")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_merged(spark, sf_dir)[0])


@query(f"{NEW_CUSTOMERS} SELECT count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'skipped') AS skipped FROM merged")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts(_merged(spark, sf_dir)[0])


@query(f"{NEW_CUSTOMERS} SELECT m.c_custkey, n.c_custkey IS NOT NULL AS is_active, CASE WHEN n.c_custkey IS NULL THEN 'expired' ELSE 'open' END AS state FROM merged m LEFT JOIN new n ON m.c_custkey = n.c_custkey")
def deactivate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, new = _merged(spark, sf_dir)
    rows = merged.select("c_custkey").withColumns({"is_active": F.lit(True), "state": F.lit("open")})
    return M.deactivate_missing(rows, new, ["c_custkey"], "state")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey")
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rounded(M.unknown(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), known, "l_orderkey"))


@query("SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def membership_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    turn = F.lit("2024-01-15").cast("timestamp_ntz")
    old = e.where(F.col("ts") < turn).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return M.membership(old, e.where(F.col("ts") >= turn).select("user_id", "event_type", F.col("ts").alias("at")), ["user_id", "event_type"])
