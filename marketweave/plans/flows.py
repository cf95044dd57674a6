"""Queries for collection runs, classification in stages and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketweave.operators import collection as C
from marketweave.operators import decisions as D
from marketweave.operators import quality as Q
from marketweave.operators import runs as R
from marketweave.plans.series import rounded
from marketweave.session import saved, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _hour(c: str) -> Column:
    return F.date_trunc("hour", F.col(c))


@query("""WITH i AS (SELECT event_id, event_type AS symbol, ts AS a, date_trunc('hour', ts) + INTERVAL 2 HOUR AS b, CASE event_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 3600 END AS step FROM events),
f AS (SELECT event_id, list_filter([CASE WHEN symbol NOT IN ('view', 'click', 'purchase') THEN 'symbol' END, CASE WHEN step IS NULL THEN 'interval' END, CASE WHEN a >= b THEN 'range' END,
CASE WHEN coalesce(epoch(a)::BIGINT % step <> 0 OR epoch(b)::BIGINT % step <> 0, false) OR coalesce(epoch_us(a) % 1000000 < 0, false) THEN 'alignment' END, CASE WHEN b > TIMESTAMP '2024-01-20' THEN 'open' END], lambda x: x IS NOT NULL) AS faults FROM
(SELECT event_id, symbol, date_trunc('second', a) AS a, b, step FROM i))
SELECT event_id, array_to_string(faults, ',') AS faults, CASE WHEN len(faults) = 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN len(faults) > 0 THEN 'pending' WHEN event_id % 4 > 0 THEN 'issues' ELSE 'passed' END AS quality FROM f""")
def inspection_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ranges to be inspected: symbols, intervals, alignment and closed candles, and the state of each."""
    k = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").withColumn("a", F.date_trunc("second", "ts"))
    step = F.when(k == 0, 300).when(k == 1, 3600)
    closed = F.lit("2024-01-20").cast("timestamp_ntz")
    told = e.withColumn("faults", C.input_faults(F.col("event_type"), F.col("a"), _hour("ts") + F.expr("INTERVAL 2 HOURS"), step, closed, ["view", "click", "purchase"]))
    state = C.inspection_state(F.col("faults"), F.col("event_id") % 4)
    return told.select("event_id", F.array_join("faults", ",").alias("faults"), state["status"].alias("status"), state["quality"].alias("quality"))


@query("""SELECT o_custkey AS run, CASE WHEN NOT bool_or(o_orderkey % 11 = 0) THEN 'success' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'partial' ELSE 'failed' END AS status,
CASE WHEN count(*) FILTER (WHERE o_orderkey % 7 = 0) = 0 THEN 'success' WHEN count(*) FILTER (WHERE o_orderstatus <> 'P') > 0 THEN 'partial' ELSE 'failed' END AS finish FROM orders GROUP BY o_custkey""")
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by what was kept before an error, and runs that go on after failures."""
    o = table(spark, sf_dir, "orders")
    kept = lambda s: F.count_if(F.col("o_orderstatus") == s)
    sums = o.groupBy(F.col("o_custkey").alias("run")).agg(F.bool_or(F.col("o_orderkey") % 11 == 0).alias("error"), kept("F").alias("created"), kept("O").alias("updated"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("failed"))
    return sums.select("run", C.run_status(F.col("error"), F.col("created")).alias("status"), C.finished(F.col("created"), F.col("updated"), F.col("failed")).alias("finish"))


@query("""WITH p AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 11 AS digest, o_orderkey % 13 AS parsed, o_orderkey % 3 AS invalid, o_orderdate::DATE AS earliest, DATE '1996-01-01' AS boundary FROM orders),
r AS (SELECT *, CASE WHEN parsed = 0 AND page = 1 THEN 'no_entries' WHEN parsed = 0 THEN 'completed' WHEN row_number() OVER (PARTITION BY run, digest ORDER BY page) > 1 THEN 'page_loop' WHEN earliest < boundary THEN 'reached_boundary' WHEN page >= 5 THEN 'page_cap' END AS reason FROM p),
s AS (SELECT run, arg_min(reason, page) AS reason, min(page) AS last FROM r WHERE reason IS NOT NULL GROUP BY run)
SELECT run, count(*) AS pages, coalesce(max(s.reason), 'request_failed') AS reason, sum(CASE WHEN r.reason = 'page_loop' THEN 0 ELSE parsed END)::BIGINT AS parsed, sum(CASE WHEN r.reason = 'page_loop' THEN 0 ELSE invalid END)::BIGINT AS invalid,
coalesce(max(s.reason), '') IN ('completed', 'reached_boundary') AS complete FROM r LEFT JOIN s USING (run) WHERE last IS NULL OR page <= last GROUP BY run""")
def feed_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages of a feed: loops by digest, boundaries, empty pages and the page cap."""
    k = F.col("o_orderkey")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), page.alias("page"), (k % 11).alias("digest"), (k % 13).alias("parsed"), (k % 3).alias("invalid"), F.to_date("o_orderdate").alias("earliest"), F.lit("1996-01-01").cast("date").alias("boundary"))
    found = C.feed_pages(pages, "run", 5)
    return found.withColumns({"parsed": F.col("parsed").cast("long"), "invalid": F.col("invalid").cast("long")})


@query("""SELECT l_orderkey AS run, count(*) AS requests, sum(l_quantity::INT)::BIGINT AS received, sum((l_returnflag = 'N')::INT)::BIGINT AS inserted, sum((l_returnflag = 'R')::INT)::BIGINT AS updated, sum((l_returnflag = 'A')::INT)::BIGINT AS skipped,
CASE WHEN NOT bool_or(l_linenumber = 6) THEN 'success' WHEN sum((l_returnflag <> 'A')::INT) > 0 THEN 'partial' ELSE 'failed' END AS status,
(sum((l_tax > 0.07)::INT) + bool_or(l_linenumber = 6)::INT)::BIGINT AS failed FROM lineitem GROUP BY l_orderkey""")
def diagnostics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: c.cast("int").cast("long")
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.lit(1).cast("long").alias("requests"), n(F.col("l_quantity")).alias("candidates"), n(flag == "N").alias("inserted"), n(flag == "R").alias("updated"), n(flag == "A").alias("duplicates"), n(F.col("l_tax") > 0.07).alias("invalid"), (F.col("l_linenumber") == 6).alias("error"))
    return C.diagnostics_sum(rows, "run", "error")


@query("""WITH a AS (SELECT event_type AS source, ts AS retrieved, sha256(event_id::VARCHAR) AS digest FROM events)
SELECT source, retrieved, max(digest) AS digest FROM a WHERE (source, retrieved) IN (SELECT source, max(retrieved) FROM a GROUP BY source) GROUP BY ALL""")
def source_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each source, by time and digest."""
    answers = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "ts", F.col("event_id").cast("string").alias("content"))
    return C.latest_diagnostics(answers, "source", "ts", "content")


@query("""SELECT o_orderkey AS id, o_orderdate::DATE AS claimed_for, DATE '1996-06-01' AS last_run, (DATE '1996-06-01' + INTERVAL 1 DAY)::DATE AS next_run FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate::DATE <= DATE '1996-06-01'""")
def due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as schedules: those that are due are claimed and set to the next day."""
    now = F.lit("1996-06-01").cast("date")
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("enabled"), F.to_date("o_orderdate").alias("due"))
    return C.claims(s, now, F.date_add(now, 1))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS kind, o_orderkey % 5000 AS key, o_orderstatus = 'P' AS running FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) = 1 AS first FROM r WHERE NOT running),
t AS (SELECT *, row_number() OVER (PARTITION BY kind, first ORDER BY id) AS turn FROM n)
SELECT id, CASE WHEN NOT first THEN 'repeated' WHEN kind IN (SELECT kind FROM r WHERE running) OR turn > 1 THEN 'busy' ELSE 'created' END AS outcome FROM t""")
def admitted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of a kind at a time, and one per request key."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("kind"), (k % 5000).alias("key"), (F.col("o_orderstatus") == "P").alias("running"))
    return C.admitted(r, "kind", "key", ["id"]).select("id", "outcome")


@query("""WITH c AS (SELECT l_orderkey AS run, CASE WHEN l_linestatus = 'F' THEN 'success' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_orderkey % 3 = 0 THEN 'failed' ELSE 'pending' END AS status FROM lineitem)
SELECT run, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'failed') AS failures, count(*) FILTER (WHERE status = 'pending') AS open FROM c GROUP BY run""")
def closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed runs close their pending children."""
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_linestatus") == "F", "success").when(F.col("l_returnflag") == "R", "failed").otherwise("pending").alias("status"))
    return C.closed_children(children.select("run").distinct().select("run", (F.col("run") % 3 == 0).alias("failed")), children)


@query("""WITH r AS (SELECT DISTINCT event_type AS symbol, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS stop FROM events),
w AS (SELECT *, CASE WHEN symbol = 'view' THEN stop + INTERVAL 1 HOUR ELSE stop END AS last FROM r),
h AS (SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS slot FROM events)
SELECT *, expected - actual AS missing FROM (SELECT w.symbol, w.start, w.last, ((epoch(w.last) - epoch(w.start)) / 3600)::BIGINT AS expected, count(h.slot) AS actual
FROM w LEFT JOIN h ON h.symbol = w.symbol AND h.slot >= w.start AND h.slot < w.last GROUP BY w.symbol, w.start, w.last)""")
def collect_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected days and the ranges that are inspected after them; views are stamped with the ends of their hours."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts")
    ranges = e.select(F.col("event_type").alias("symbol"), day.alias("start")).distinct().select("symbol", "start", (F.col("start") + F.expr("INTERVAL 1 DAY")).alias("end"), (F.col("symbol") == "view").alias("period_ends"))
    found = C.inspected_ranges(ranges, e.select(F.col("event_type").alias("symbol"), "ts"), "symbol", 3600)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select("symbol", ntz("start"), ntz("last"), "expected", "actual", "missing")


_CASCADE = """WITH rec AS (SELECT l_orderkey % 50 AS run, l_orderkey * 1000 + l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id, CASE WHEN l_suppkey % 7 = 0 THEN 'bullish' END AS rule, l_returnflag = 'A' AS summary_only,
    CASE WHEN l_quantity::INT % 3 = 0 THEN 'unclear' WHEN l_quantity::INT % 3 = 1 THEN 'bullish' ELSE 'bearish' END AS told, 1 + l_linenumber % 2 AS requests, l_partkey % 401 = 0 AS fatal FROM lineitem),
{stages}
done AS (SELECT run, id, 'title_rule' AS stage, 'success' AS status, rule AS conclusion FROM rec WHERE rule IS NOT NULL {union}),
ends AS (SELECT run, bool_or(fatal_batch AND served) AS stopped FROM (SELECT run, fatal_batch, served FROM title_ai UNION ALL SELECT run, fatal_batch, served FROM summary_ai UNION ALL SELECT run, fatal_batch, served FROM content_ai) GROUP BY run)
SELECT d.run, d.id, d.stage, d.status, d.conclusion FROM done d LEFT JOIN ends e USING (run) WHERE NOT (coalesce(e.stopped, false) AND d.status = 'skipped' AND d.stage IN ('summary_ai', 'content_ai'))"""


def _stage_sql(stage: str, source: str, spent: str) -> str:
    """The batches of a stage: what they take, whether requests were left, and what became of their records."""
    return f"""{stage}_q AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY id) - 1) // 20 AS batch FROM {source}),
{stage}_b AS (SELECT run, batch, max(requests) AS take, bool_or(fatal) AS fatal_batch FROM {stage}_q GROUP BY run, batch),
{stage}_s AS (SELECT b.*, coalesce(used, 0) + coalesce(sum(take) OVER w, 0) < 60 AND NOT coalesce(stopped, false) AND NOT coalesce(bool_or(fatal_batch) OVER w, false) AS served
    FROM {stage}_b b LEFT JOIN ({spent}) s USING (run) WINDOW w AS (PARTITION BY run ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{stage} AS (SELECT q.*, take, fatal_batch, served, CASE WHEN NOT served THEN 'skipped' WHEN fatal_batch THEN 'failed' ELSE 'success' END AS status FROM {stage}_q q JOIN {stage}_s USING (run, batch)),"""


def _spent_sql(*stages: str) -> str:
    parts = " UNION ALL ".join(f"SELECT DISTINCT run, batch, '{s}' AS stage, take, fatal_batch FROM {s} WHERE served" for s in stages)
    return f"SELECT run, sum(take) AS used, bool_or(fatal_batch) AS stopped FROM ({parts}) GROUP BY run"


_UNCLEAR = "(SELECT run, id, summary_only, told, requests, fatal FROM title_ai WHERE status = 'success' AND told = 'unclear' AND {which})"
_STAGES = "\n".join([
    _stage_sql("title_ai", "(SELECT * FROM rec WHERE rule IS NULL)", "SELECT NULL::BIGINT AS run, 0 AS used, false AS stopped"),
    _stage_sql("summary_ai", _UNCLEAR.format(which="summary_only"), _spent_sql("title_ai")),
    _stage_sql("content_ai", _UNCLEAR.format(which="NOT summary_only"), _spent_sql("title_ai", "summary_ai")),
])
_UNION = " ".join(f"UNION ALL SELECT run, id, '{s}', status, CASE WHEN status = 'success' THEN told END FROM {s} WHERE {w}" for s, w in (("title_ai", "status <> 'success' OR told <> 'unclear'"), ("summary_ai", "true"), ("content_ai", "true")))


@query(_CASCADE.format(stages=_STAGES, union=_UNION))
def classification_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as news of 50 runs: rules, then batches of 20 titles, summaries and bodies within 60 requests, with fatal stops."""
    q = F.col("l_quantity").cast("int") % 3
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("run"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + place).alias("id"),
        F.when(F.col("l_suppkey") % 7 == 0, "bullish").alias("rule"),
        (F.col("l_returnflag") == "A").alias("summary_only"),
        F.when(q == 0, "unclear").when(q == 1, "bullish").otherwise("bearish").alias("conclusion"),
        (1 + F.col("l_linenumber") % 2).alias("requests"),
        (F.col("l_partkey") % 401 == 0).alias("fatal"),
    )
    rows = saved(rows)
    answers = rows.select("run", "id", F.explode(F.array(*map(F.lit, D.STAGES))).alias("stage"), "conclusion", "requests", "fatal")
    return D.cascade(rows.select("run", "id", "rule", "summary_only"), answers, 20, 60)


@query("""SELECT l_orderkey AS run, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 AND count(*) FILTER (WHERE l_returnflag = 'A') = 0 THEN 'success' WHEN count(*) FILTER (WHERE l_returnflag = 'N') > 0 THEN 'partial' ELSE 'failed' END AS status FROM lineitem GROUP BY l_orderkey""")
def classification_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("l_returnflag") == s)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(D.run_result(count("N"), count("R"), count("A")).alias("status"))


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'skip' WHEN NOT d.doc_id % 7 = 0 AND coalesce(l.toxic, 0) = 1 AND d.doc_id % 3 <> 0 THEN 'delete' WHEN l.quality IS NOT NULL THEN 'update' ELSE 'insert' END AS action,
CASE WHEN d.source NOT LIKE '%1' AND d.text <> '' THEN length(d.text) ELSE length(d.lang) END AS content_chars FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""")
def saved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saving an answer does to a result, and how long the text is that is classified."""
    old = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf_dir, "documents").join(old, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "success").when(F.col("quality").isNotNull(), "failed")
    told = F.when(F.coalesce("toxic", F.lit(0)) == 1, "irrelevant").otherwise("bullish")
    action = D.saved_as(status, F.col("doc_id") % 7 == 0, told, F.col("doc_id") % 3 == 0)
    content = D.content_of(F.col("source").endswith("1"), F.col("text"), F.col("lang"))
    return rows.select("doc_id", action.alias("action"), F.char_length(content).cast("bigint").alias("content_chars"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, 0) AS input, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 9 + 7 END, 0) AS output,
coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 2 END, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, 0) + coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 9 + 7 END, 0)) AS total FROM orders""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    used = D.token_usage(F.when(k % 3 > 0, c), F.when(k % 5 > 0, k % 9 + 7), F.when(k % 2 == 0, c * 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", used.alias("u")).select("o_orderkey", "u.*")


@query("""WITH p AS (SELECT o_custkey AS a, o_orderkey AS b, CASE WHEN o_orderstatus = 'F' THEN 'object' END AS rejected FROM orders),
d AS (SELECT a, b, CASE WHEN b % 10 = 0 THEN 'uncertain' END AS old, rejected, CASE WHEN b % 4 <> 1 THEN 'same_event' END AS new FROM p)
SELECT a AS "left", b AS "right", CASE WHEN old IS NOT NULL THEN 'prior' WHEN rejected IS NOT NULL THEN 'rule' ELSE 'model' END AS source, coalesce(old, CASE WHEN rejected IS NOT NULL THEN 'different_event' END, new, 'processing_failed') AS relation FROM d""")
def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior decisions, hard rejections and a model's answers, of which some never came."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("left"), F.col("o_orderkey").alias("right"), F.when(F.col("o_orderstatus") == "F", "object").alias("rejected"))
    with_ = lambda which, relation: pairs.where(which).select("left", "right", F.lit(relation).alias("relation"))
    return D.decided(pairs, with_("right % 10 = 0", "uncertain"), with_("right % 4 <> 1", "same_event"))


@query("""SELECT (SELECT count(*) FROM customer) AS inputs, (SELECT count(DISTINCT o_custkey) FROM orders) AS eligible, count(*) AS pairs, count(*) FILTER (WHERE o_orderstatus = 'F') AS rejected, count(*) FILTER (WHERE o_orderstatus <> 'F') AS calls FROM orders""")
def merge_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work that pairs would make, without writing any."""
    o = table(spark, sf_dir, "orders")
    pairs = o.select(F.when(F.col("o_orderstatus") == "F", "object").alias("rejected"))
    return D.work_estimate(pairs, table(spark, sf_dir, "customer").count(), o.select("o_custkey").distinct().count())


@query("""WITH a AS (SELECT n_nationkey AS request, unnest([n_nationkey * 3, n_nationkey, n_nationkey * 2]) AS c_nationkey, unnest([0, 1, 2]) AS place FROM nation),
c AS (SELECT n_nationkey AS c_nationkey, n_name FROM nation)
SELECT request, place, a.c_nationkey AS id, c.n_name AS name, c.n_name IS NOT NULL AS found FROM a LEFT JOIN c USING (c_nationkey)""")
def records_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the order in which they are asked for; those that aren't there are told."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("bigint")
    asked = n.select(F.col("n_nationkey").alias("request"), F.array(k * 3, k, k * 2).alias("ids"))
    return D.in_order(asked, n.select(k.alias("id"), F.col("n_name").alias("name")), "id").select("request", "place", "id", "name", "found")


@query("""WITH f AS (SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS action, arg_min(o_orderstatus, o_orderkey) AS object FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)
SELECT c_custkey AS id, action, object FROM customer LEFT JOIN f ON id = c_custkey""")
def snapshot_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fact of nested results; some have none."""
    fact = F.struct(F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("object"))
    nested = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    results = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(nested, "id", "left").select("id", F.struct("facts").alias("result"))
    return D.projected(results, ["action", "object"])


@query("""WITH i AS (SELECT l_orderkey AS id, CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_suppkey % 8 END AS place, l_returnflag AS code FROM lineitem)
SELECT f.l_orderkey AS id, f.l_linenumber AS place, coalesce(array_to_string(list(i.code ORDER BY i.code) FILTER (WHERE i.code IS NOT NULL), ','), '') AS codes FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) f LEFT JOIN i ON i.id = f.l_orderkey AND i.place = f.l_linenumber GROUP BY f.l_orderkey, f.l_linenumber""")
def fact_issue_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the issues whose path begins with theirs."""
    li = table(spark, sf_dir, "lineitem")
    path = F.when(F.col("l_partkey") % 3 == 0, "summary").otherwise(F.concat(F.lit("facts["), (F.col("l_suppkey") % 8).cast("string"), F.lit("].evidence_text")))
    told = D.with_issues(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place")).distinct(), li.select(F.col("l_orderkey").alias("id"), path.alias("path"), F.col("l_returnflag").alias("code")))
    return told.withColumn("codes", F.array_join("codes", ","))


@query("""SELECT o_orderkey AS id, o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS current FROM orders""")
def current_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last successful run of each customer is the current one."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("success"))
    return D.activated(r, "o_custkey", ["o_orderdate", "id"]).select("id", "current")


@query("""SELECT doc_id AS id, CASE WHEN coalesce(text, '') <> '' AND doc_id % 9 > 0 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN coalesce(text, '') <> '' AND doc_id % 9 > 0 THEN sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') END AS digest FROM documents""")
def frozen_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending results with the digest of their input; every ninth document has no body."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "doc_id", "lang", F.when(F.col("doc_id") % 9 > 0, F.col("text")).alias("body"))
    return D.frozen(d, ["doc_id", "lang"]).select("id", "status", "digest")


@query("""SELECT event_id, date_trunc('minute', ts) AS start, date_trunc('minute', CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-02-01 10:20:30' ELSE ts + INTERVAL 90 SECOND END) + INTERVAL 1 MINUTE AS stop,
CASE WHEN ts::DATE > DATE '2024-01-20' THEN 'end_before_start' END AS fault FROM events""")
def run_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole minutes of runs, of which every fourth is open, and a check of the dates that a filter gives."""
    stop = F.when(F.col("event_id") % 4 > 0, F.col("ts") + F.expr("INTERVAL 90 SECONDS"))
    start, end = C.run_bounds(F.col("ts"), stop, F.lit("2024-02-01 10:20:30").cast("timestamp_ntz"))
    ntz = lambda c: c.cast("timestamp_ntz")
    fault = F.when(F.to_date("ts") > F.lit("2024-01-20").cast("date"), "end_before_start")
    return table(spark, sf_dir, "events").select("event_id", ntz(start).alias("start"), ntz(end).alias("stop"), fault.alias("fault"))


@query("""WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), l AS (SELECT max(day) AS latest FROM d),
r AS (SELECT day, day - 1 AS a, day + CASE WHEN day = latest THEN 1 ELSE 2 END AS b FROM d, l), e AS (SELECT ts::DATE AS on_day, count(*) AS n FROM events GROUP BY on_day)
SELECT day, sum(n)::BIGINT AS shown FROM r JOIN e ON on_day >= a AND on_day < b GROUP BY day""")
def linked_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are shown around each day: three days, or two around the latest."""
    per_day = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("at")).agg(F.count("*").alias("n"))
    latest = per_day.agg(F.max("at").alias("latest"))  # one row
    start, end = C.linked_range(F.col("day"), F.col("latest"))
    days = per_day.select(F.col("at").alias("day"), F.lit(1).alias("k")).join(latest.withColumn("k", F.lit(1)), "k").select("day", F.explode(F.sequence(start, F.date_sub(end, 1))).alias("at"))
    return days.join(per_day, "at").groupBy("day").agg(F.sum("n").alias("shown"))


@query("""WITH m AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, avg(value) AS mean FROM events GROUP BY ALL)
SELECT symbol, round(greatest(max(abs(mean * 100)) * 1.15, 0.01), 4) AS top, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = s.symbol AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')) AS others FROM m s GROUP BY symbol""")
def scale_and_set_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of a chart of means, and users of a kind of events who have no errors."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "symbol")
    means = e.groupBy("symbol", _hour("ts").alias("hour")).agg(F.avg("value").alias("mean"))
    top = means.groupBy("symbol").agg(Q.scale_top(F.col("mean") * 100).alias("top"))
    users = e.select("symbol", "user_id").distinct().join(e.where("symbol = 'error'").select("user_id").distinct(), "user_id", "left_anti")
    others = users.groupBy("symbol").agg(F.count("*").alias("others"))
    return top.join(others, "symbol", "left").select("symbol", F.round("top", 4).alias("top"), F.coalesce("others", F.lit(0)).alias("others"))


@query("""SELECT event_type AS symbol, arg_max(event_id, (ts, event_id)) AS update_id, round(arg_max(value, (ts, event_id)), 6) AS bid, '{"symbol":"' || event_type || '","events":' || count(*) || '}' AS progress FROM events WHERE value > 0 GROUP BY event_type""")
def latest_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last book with levels of each symbol, and a row of progress as JSON."""
    e = table(spark, sf_dir, "events").where("value > 0").withColumnRenamed("event_type", "symbol")
    last = F.max(F.struct("ts", "event_id", "value")).alias("x")
    found = e.groupBy("symbol").agg(last, F.count("*").alias("events"))
    return rounded(found.select("symbol", F.col("x.event_id").alias("update_id"), F.col("x.value").alias("bid"), F.to_json(F.struct("symbol", "events")).alias("progress")))


@query("""WITH r AS (SELECT o_orderstatus AS status, o_orderdate AS began FROM orders), l AS (SELECT max(began) AS now FROM r)
SELECT status, count(*) AS runs FROM (SELECT CASE WHEN status = 'O' AND began < now - INTERVAL 30 DAY THEN 'failed' WHEN status = 'O' THEN 'running' ELSE 'done' END AS status FROM r, l) GROUP BY status""")
def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running runs that are older than 30 days at the time of the last one."""
    o = table(spark, sf_dir, "orders").select(F.lit(1).alias("k"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("started"))
    last = o.groupBy("k").agg(F.max("started").alias("now"))
    runs = o.join(last, "k").withColumn("heartbeat", F.lit(None).cast("timestamp_ntz"))
    return R.recover_stale(runs, F.col("now"), 30 * 24 * 60).groupBy("status").agg(F.count("*").alias("runs"))
