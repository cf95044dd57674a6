"""Queries for checks of answers and facts, runs, schedules and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.operators import runs as R
from marketweave.operators import validation as V
from marketweave.plans.series import rounded
from marketweave.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LITERALS = ["2024", "2024-Q3", "2024-Q5", "2024-13", "2024-02", "2024-02-30", "2024-02-29", "2024-02-29/2024-03", "a/b/c", ""]


@query("SELECT doc_id, [" + ", ".join(f"'{x}'" for x in _LITERALS) + "][(doc_id % 10 + 1)::INT] AS value, doc_id % 10 IN (0, 1, 4, 6, 7) AS valid FROM documents")
def time_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.element_at(F.array(*[F.lit(x) for x in _LITERALS]), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("value")).withColumn("valid", V.time_literal(F.col("value")))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS statement, generate_subscripts(string_split(text, '.'), 1) AS n FROM documents),
k AS (SELECT *, lower(trim(regexp_replace(statement, '\s+', ' ', 'g'))) AS key FROM s)
SELECT doc_id, count(*) AS facts, count(*) FILTER (WHERE key = '') + count(DISTINCT CASE WHEN key <> '' THEN key END) AS kept FROM k GROUP BY doc_id""")
def fact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.transform(F.split("text", r"\."), lambda s: F.struct(s.alias("statement")))
    kept = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", facts.alias("all"))
    return kept.select("doc_id", F.size("all").cast("bigint").alias("facts"), F.size(V.first_facts(F.col("all"))).cast("bigint").alias("kept"))


@query("""WITH s AS (SELECT o_custkey AS key, o_orderkey % 997 AS start, o_orderkey % 997 + o_orderkey % 41 AS stop FROM orders),
m AS (SELECT *, max(stop) OVER (PARTITION BY key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT key, min(start) AS start, max(stop) AS stop FROM i GROUP BY key, island""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") % 997
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), start.alias("start"), (start + F.col("o_orderkey") % 41).alias("stop"))
    return V.merged_spans(spans, ["key"])


@query("""SELECT o_custkey AS batch, array_to_string(list_filter([
    CASE WHEN bool_or(o_orderstatus NOT IN ('F', 'O')) THEN 'bad_conclusion' END,
    CASE WHEN bool_or(o_orderkey % 5 = 0) THEN 'no_rationale' END,
    CASE WHEN count(*) > 15 THEN 'foreign_id' END,
    CASE WHEN count(*) <= 15 AND false THEN 'absent_id' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders GROUP BY o_custkey""")
def direction_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a model's answer; the first 15 order keys were asked for."""
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.col("o_orderkey").alias("news_id"), F.col("o_orderstatus").alias("conclusion"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("because").alias("rationale"), F.lit("s").alias("content_summary"))
    batches = o.groupBy(F.col("o_custkey").alias("batch")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    asked = F.slice(F.transform("items", lambda x: x["news_id"]), 1, 15)
    return batches.select("batch", F.array_join(V.direction_errors(F.col("items"), asked, ["F", "O"]), ",").alias("errors"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'inferred' WHEN event_id % 4 = 2 THEN NULL ELSE 'explicit' END AS support FROM events""")
def publication_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("On "), F.date_format(day, "MMMM d, yyyy"), F.lit(" it was said"))).when(kind == 1, F.concat(F.lit("as of "), F.date_format(day, "yyyy-MM-dd"))).when(kind == 3, "said today").otherwise("some time ago")
    return table(spark, sf_dir, "events").select("event_id", V.publication_date(text, day).alias("support"))


@query()
def fact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents as facts; every third quotes what the document doesn't say."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    fact = lambda s, i: F.struct(s.alias("statement"), F.when(i % 5 == 4, "x").otherwise("reported").alias("claim_type"), F.when(i % 3 == 2, F.concat(s, F.lit(" never said"))).otherwise(s).alias("evidence_text"), F.when(i == 0, F.lit("2024-05-01")).alias("fact_time"))
    rows = d.select(F.col("doc_id").alias("id"), F.lit("2024-05-01").alias("event_time"), F.transform(F.split("text", r"\."), fact).alias("facts"), F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), F.lit("").alias("summary"), F.col("text").alias("body"))
    return V.fact_issues(rows, ["reported", "claimed"])


@query("""SELECT l_orderkey AS run, CASE WHEN bool_and(l_linestatus = 'F') THEN 'success' WHEN bool_or(l_linestatus = 'F') THEN 'partial' ELSE 'failed' END AS status, count(*) AS steps,
sum(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 10 ELSE l_linenumber + 3 END)::BIGINT AS used FROM lineitem GROUP BY l_orderkey""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("status"), n.alias("prompt"), F.lit(3).alias("completion"), F.when(n % 2 == 0, n * 10).alias("total"))
    return R.roll_up(steps, "run").withColumn("used", F.col("used").cast("bigint"))


@query("""SELECT status, count(*) AS runs FROM (SELECT CASE WHEN o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 15 MINUTE THEN 'failed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status FROM orders) GROUP BY status""")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("k", F.lit(1))
    runs = o.join(o.groupBy("k").agg(F.max("o_orderdate").alias("now")), "k")
    runs = runs.select("now", F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("started"), F.lit(None).cast("timestamp_ntz").alias("heartbeat"))
    return R.recover_stale(runs, F.col("now")).groupBy("status").agg(F.count("*").alias("runs"))


_LOCAL = "(ts + INTERVAL 8 HOUR)"


@query(f"""WITH s AS (SELECT event_id, ts, (event_id % 24) * 3600 AS sec, [1, 2, 4, 6, 8, 12, 24][(event_id % 7 + 1)::INT] AS h FROM events),
a AS (SELECT *, epoch({_LOCAL}) AS l, epoch(date_trunc('day', {_LOCAL})) + sec AS due FROM s)
SELECT event_id, make_timestamp(((CASE WHEN due > l THEN due ELSE due + (floor((l - due) / (h * 3600)) + 1) * h * 3600 END) * 1000000)::BIGINT) - INTERVAL 8 HOUR AS next FROM a""")
def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hours = F.element_at(F.array(*[F.lit(h) for h in (1, 2, 4, 6, 8, 12, 24)]), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", R.next_interval(F.col("ts"), F.col("event_id") % 24 * 3600, hours).cast("timestamp_ntz").alias("next"))


@query("""WITH p AS (SELECT o_custkey AS run, CASE WHEN o_orderkey % 97 = 0 THEN 503 ELSE 200 END AS http, o_orderkey % 5 AS parsed, (o_orderkey % 31 = 0)::INT AS invalid, (o_orderkey % 17 = 0)::INT AS retries, o_orderstatus <> 'P' AS complete, o_orderkey AS last FROM orders),
s AS (SELECT run, bool_and(http BETWEEN 200 AND 299) AS a, sum(parsed) > 0 AS b, arg_max(complete, last) AS c, sum(parsed)::BIGINT AS parsed, sum(invalid)::BIGINT AS invalid, sum(retries)::BIGINT AS retries FROM p GROUP BY run)
SELECT run, parsed, invalid, retries, CASE WHEN NOT (a AND b AND c) THEN 'failed' WHEN retries > 0 OR invalid > 0 THEN 'warning' ELSE 'passed' END AS quality,
((NOT a)::INT + (NOT b)::INT + (NOT c)::INT + (invalid > 0)::INT + (retries > 0)::INT)::BIGINT AS issues FROM s""")
def page_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.when(k % 97 == 0, 503).otherwise(200).alias("http"), (k % 5).alias("parsed"), (k % 31 == 0).cast("int").alias("invalid"), (k % 17 == 0).cast("int").alias("retries"), (F.col("o_orderstatus") != "P").alias("complete"), k.alias("last"))
    return rounded(R.inspect_pages(pages, "run").select("run", "parsed", "invalid", "retries", "quality", "issues"))


@query("""WITH d AS (SELECT o_orderpriority AS name, o_orderdate::DATE AS day, o_totalprice - 1000 AS value FROM orders),
s AS (SELECT name, count(*) AS actual, count(DISTINCT day) AS days, date_diff('day', min(day), max(day)) + 1 AS expected, count(*) FILTER (WHERE value < 0) AS invalid FROM d GROUP BY name)
SELECT name, actual, days, expected, invalid, expected - days AS missing, actual - days AS duplicate, CASE WHEN expected - days + actual - days + invalid > 0 THEN 'issues' ELSE 'passed' END AS quality FROM s""")
def fund_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") - 1000).alias("value"))
    return rounded(R.fund_audit(daily, ["name"]))


# JSON of each row by column name, as it is hashed; sums of eight hexadecimal digits
_ROW_JSON = "'{' || concat_ws(',', '\"o_custkey\":' || o_custkey, '\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '\"', '\"o_orderkey\":' || o_orderkey, '\"o_orderpriority\":\"' || o_orderpriority || '\"', '\"o_orderstatus\":\"' || o_orderstatus || '\"', '\"o_totalprice\":' || o_totalprice) || '}'"


@query(f"""WITH h AS (SELECT sha256({_ROW_JSON}) AS x FROM orders)
SELECT count(*) AS rows, {" || '-' || ".join(f"CAST(sum(CAST('0x' || substr(x, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(4))} AS fingerprint FROM h""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fingerprint(table(spark, sf_dir, "orders"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS event_id FROM orders WHERE o_orderkey % 50 <> 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 60 = 1),
e AS (SELECT o_custkey AS event_id, count(*) AS size FROM orders GROUP BY o_custkey)
SELECT 'absent' AS fault, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM m) UNION ALL SELECT 'repeated', id FROM m GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'size', e.event_id FROM e LEFT JOIN (SELECT event_id, count(*) AS n FROM m GROUP BY event_id) s USING (event_id) WHERE coalesce(n, 0) <> size""")
def snapshot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("event_id"))
    members = o.where("id % 50 <> 0").unionByName(o.where("id % 60 = 1"))
    events = o.groupBy("event_id").agg(F.count("*").alias("size"))
    return R.snapshot_faults(o.select("id"), members, events)


@query("""SELECT d.doc_id AS id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def incremental_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"), F.lit(1).alias("at"))
    return R.selection(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), results, "incremental")


@query("""SELECT doc_id AS id FROM labels WHERE quality <> 1 AND doc_id IN (SELECT doc_id FROM documents)""")
def retry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"), F.lit(1).alias("at"))
    return R.selection(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), results, "retry")
