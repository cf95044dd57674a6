"""Queries over documents and pages as news, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions import html, numeric, text, timegrid
from marketweave.operators import depth as D
from marketweave.operators import events as E
from marketweave.operators import news as N
from marketweave.plans.series import _BARS, _bars_sql, rounded
from marketweave.session import cut, table
from marketweave.streaming import minutes

QUERIES, ORACLE_SQL = {}, {}


_TITLE = "split_part(text, chr(10), 1)"


def _title():
    """A document's first line stands for its title."""
    return F.split_part(F.col("text"), F.lit("\n"), F.lit(1))


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(r"""WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS h,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS p,
    array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(regexp_extract(x, '^([^=]*)', 1)), 'utm_')
        AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'referrer', 'source')), '&') AS k FROM p)
SELECT page_id, CASE WHEN u = '' THEN '' ELSE s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN k <> '' THEN '?' || k ELSE '' END END AS url FROM q""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query(f"""SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN 'item:' || doc_id WHEN doc_id % 3 = 1 THEN 'url:https://' || source || '/' || doc_id
ELSE 'fingerprint:2024-01-01T00:00:00:' || trim({_TITLE}) END) AS identity FROM documents""")
def identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    item = F.when(kind == 0, F.col("doc_id").cast("string"))
    url = F.when(kind == 1, F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return d.select("doc_id", text.identity(item, url, at, _title()).alias("identity"))


@query(f"""WITH a AS (SELECT *, sha256(coalesce(text, '')) AS body, sha256(coalesce({_TITLE}, '')) AS head FROM documents),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source, body ORDER BY doc_id) = 1)
SELECT doc_id, source FROM b QUALIFY row_number() OVER (PARTITION BY source, head ORDER BY doc_id) = 1""")
def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    items = table(spark, sf_dir, "documents").select("doc_id", "source", digest(F.col("text")).alias("body"), digest(_title()).alias("head"))
    return N.dedup(items, "source", ["body", "head"], "doc_id").select("doc_id", "source")


_GENERIC = ", ".join(f"'{w}'" for w in text.GENERIC_TITLE_TOKENS)


@query(rf"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: len(x) >= 3 AND x NOT IN ({_GENERIC}) AND NOT regexp_matches(x, '^[0-9]+$')))), ' ') AS tokens FROM t""")
def significant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.significant_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with titles, some of which meet a rule."""
    d = table(spark, sf_dir, "documents")
    lead = F.when(F.col("doc_id") % 11 == 0, "SEC approves spot Ethereum ETF ").when(F.col("doc_id") % 11 == 1, "Trading competition: ").when(F.col("doc_id") % 11 == 2, "Court denied  Ether ETF ").when(F.col("doc_id") % 11 == 3, "Word of the Day quiz ").otherwise("")
    return d.select("doc_id", "source", F.concat(lead, _title()).alias("title"))


def _rules_sql() -> str:
    tests = [("source = 'src5'", *N.OFFICIAL_RULE)]
    tests += [(f"source = 'src1' AND regexp_matches(t, '(?i){p}')", n, c) for n, p, c in N.EXCHANGE_RULES]
    tests += [(f"regexp_matches(t, '(?i){p}')", n, c) for n, p, c in N.ASSET_RULES]
    pick = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in tests) + " END"
    return f"""WITH d AS (SELECT doc_id, source, trim(regexp_replace(CASE doc_id % 11 WHEN 0 THEN 'SEC approves spot Ethereum ETF ' WHEN 1 THEN 'Trading competition: ' WHEN 2 THEN 'Court denied  Ether ETF ' WHEN 3 THEN 'Word of the Day quiz ' ELSE '' END || {_TITLE}, '\\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, {pick(1)} AS rule, {pick(2)} AS conclusion FROM d"""


@query(_rules_sql())
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.title_rule(F.col("title"), F.col("source") == "src1", F.col("source") == "src5")
    return _titles(spark, sf_dir).select("doc_id", found.alias("r")).select("doc_id", "r.rule", "r.conclusion")


@query("""WITH r AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'unclear' ELSE 'bullish' END AS conclusion, TIMESTAMP '2024-01-10' - INTERVAL 1 HOUR * (doc_id % 200) AS published, source = 'src5' AS official FROM documents)
SELECT id, conclusion FROM r WHERE NOT ((conclusion = 'irrelevant' OR (conclusion = 'unclear' AND published < TIMESTAMP '2024-01-10' - INTERVAL 3 DAY AND NOT official)) AND id NOT IN (SELECT doc_id FROM labels))""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(kind == 0, "irrelevant").when(kind == 1, "unclear").otherwise("bullish").alias("conclusion"), (now - F.make_interval(hours=(F.col("doc_id") % 200).cast("int"))).alias("published"), (F.col("source") == "src5").alias("official"))
    return N.retained(results, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), now).select("id", "conclusion")


@query(r"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS summary, text AS body,
    CASE doc_id % 3 WHEN 0 THEN split_part(text, chr(10), 2) WHEN 1 THEN regexp_replace(split_part(text, chr(10), 3), '\s+', '  ', 'g') ELSE regexp_replace(split_part(text, '. ', 2), '\s+', '  ', 'g') || 'x' END AS quote FROM documents),
t AS (SELECT *, trim(regexp_replace(quote, '\s+', ' ', 'g')) AS q, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t1, trim(regexp_replace(summary, '\s+', ' ', 'g')) AS s1, trim(regexp_replace(body, '\s+', ' ', 'g')) AS b1 FROM d)
SELECT doc_id, CASE WHEN q = '' THEN NULL WHEN contains(title, quote) THEN 'title:exact' WHEN contains(summary, quote) THEN 'summary:exact' WHEN contains(body, quote) THEN 'body:exact'
WHEN contains(t1, q) THEN 'title:normalized' WHEN contains(s1, q) THEN 'summary:normalized' WHEN contains(b1, q) THEN 'body:normalized' END AS match FROM t""")
def evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    line = lambda n: F.split_part(F.col("text"), F.lit("\n"), F.lit(n))
    wide = lambda c: F.regexp_replace(c, r"\s+", "  ")
    quote = F.when(kind == 0, line(2)).when(kind == 1, wide(line(3))).otherwise(F.concat(wide(F.split_part(F.col("text"), F.lit(". "), F.lit(2))), F.lit("x")))
    rows = table(spark, sf_dir, "documents").select("doc_id", line(1).alias("title"), line(2).alias("summary"), "text", quote.alias("quote"))
    return rows.select("doc_id", text.evidence(F.col("quote"), F.col("title"), F.col("summary"), F.col("text")).alias("match"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT *, regexp_extract(substr(t, 1, 601), '^(.*([。！？]|\. ))', 1) AS c FROM f)
SELECT doc_id, CASE WHEN length(t) <= 600 THEN t WHEN length(rtrim(c)) > 300 THEN trim(c) ELSE rtrim(substr(t, 1, 600)) || '…' END AS summary FROM s""")
def article_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("""SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.1f', v) END AS label
FROM (SELECT o_orderkey, (floor(o_totalprice / 100) * 100 + 10) * (1 + o_orderkey % 2 * 99999) AS v FROM orders)""")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (F.floor(F.col("o_totalprice") / 100) * 100 + 10).cast("double") * (1 + F.col("o_orderkey") % 2 * 99_999)
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.compact(value).alias("label"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN -(o_orderkey % 1000) * 1e6 ELSE (o_orderkey % 1000) * 1e6 END::DOUBLE AS flow FROM orders""")
def flow_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 1000).cast("string")
    kind = F.col("o_orderkey") % 4
    raw = F.when(kind == 0, "-").when(kind == 1, F.concat(F.lit("("), n, F.lit(")"))).when(kind == 2, F.concat(F.lit("$"), n)).otherwise(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.flow_value(raw).alias("flow"))


@query("""SELECT event_id, date_trunc('second', ts) AS at FROM events""")
def flexible_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    at = F.date_trunc("second", "ts").cast("timestamp")
    raw = F.when(kind == 0, F.unix_seconds(at).cast("string")).when(kind == 1, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select("event_id", timegrid.parse_when(raw).cast("timestamp_ntz").alias("at"))


@query(r"""SELECT lang, count(*) AS documents FROM documents WHERE text ILIKE '%data%' OR source ILIKE 'SRC1%' GROUP BY lang""")
def contains_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("text").ilike("%data%") | F.col("source").ilike("SRC1%")).groupBy("lang").agg(F.count("*").alias("documents"))


@query(r"""WITH s AS (SELECT conv_id, turn, regexp_replace(trim(text), '\s+', ' ', 'g') AS t FROM conversations), p AS (SELECT conv_id, max(t) FILTER (WHERE turn = 0) AS a, max(t) FILTER (WHERE turn = 1) AS b, max(t) FILTER (WHERE turn >= 2) AS c FROM s GROUP BY conv_id),
q AS (SELECT conv_id, list_filter([a, b, a, c, NULL], lambda x: x IS NOT NULL AND x <> '') AS l FROM p)
SELECT conv_id, substr(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)), 1, 12000) AS body FROM q WHERE len(l) > 0""")
def stored_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several parts of a conversation, one of them twice, joined."""
    part = lambda which: F.max(F.when(which, F.col("text")))
    turn = F.col("turn")
    # the greatest text of a range of turns, after its white space is flat
    flat = table(spark, sf_dir, "conversations").withColumn("text", text.tidy(F.col("text")))
    parts = flat.groupBy("conv_id").agg(part(turn == 0).alias("a"), part(turn == 1).alias("b"), part(turn >= 2).alias("c"))
    return parts.select("conv_id", text.stored_body([F.col("a"), F.col("b"), F.col("a"), F.col("c"), F.lit(None).cast("string")]).alias("body")).where("body <> ''")


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.article_text("html").alias("text"))


@query()
def url_normalise_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url_exact("url").alias("url"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as extracted facts: one item per conversation, of all its turns in order."""
    turns = table(spark, sf_dir, "conversations")
    c = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min_by("role", "turn").alias("role"))
    words = F.split(text.normal(F.col("text")), " ")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("conv_id") % 90) * 86_400)
    return c.select(F.col("conv_id").alias("id"), at.alias("published"), _title().alias("event_title"), F.slice(words, 1, 2).alias("actors"), F.array_join(F.slice(words, 3, 3), " ").alias("action"), F.slice(words, 6, 1).alias("object"), F.lit("occurred").alias("event_status"), F.col("text").alias("objective_summary"), F.col("role").alias("source"))


@query()
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.candidates(_facts(spark, sf_dir)))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions about the candidates, which are found once and not anew at each use."""
    found = cut(E.candidates(_facts(spark, sf_dir)))
    relation = F.when(F.col("rejected").isNotNull(), "different_event").when(F.col("score") >= 0.9, "same_event").otherwise("uncertain")
    return found.select("left", "right", relation.alias("relation"), F.col("score").alias("confidence"), F.lit(False).alias("conflict"), "score")


@query()
def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.complete_link(_facts(spark, sf_dir).select("id", "published"), _decided(spark, sf_dir))


@query()
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, decisions = _facts(spark, sf_dir).select("id", "published", "source"), _decided(spark, sf_dir)
    return rounded(E.roll_up(E.complete_link(items.select("id", "published"), decisions), items, decisions))


_PRIOR = """WITH p AS (SELECT o_custkey AS "left", o_orderkey + 10000000 AS "right", o_orderkey FROM orders),
d AS (SELECT "left", "right", o_orderkey AS decision_id, CASE WHEN o_orderkey % 5 = 0 THEN 'processing_failed' ELSE 'same_event' END AS relation, o_orderkey % 10 = 0 AS is_retryable FROM p WHERE o_orderkey % 3 > 0)"""


@query(f"""{_PRIOR} SELECT p."left", p."right", CASE WHEN decision_id IS NULL THEN 'new' WHEN relation = 'processing_failed' AND is_retryable THEN 'retry' ELSE 'clone' END AS source, decision_id,
CASE WHEN relation = 'processing_failed' AND is_retryable THEN NULL ELSE relation END AS relation FROM p LEFT JOIN d ON p."left" = d."left" AND p."right" = d."right" """)
def retry_failed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's pairs, of which some have failed: those are tried again, the other decisions are taken over. Prior pairs stand in any order."""
    o = table(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_custkey").alias("left"), (F.col("o_orderkey") + 10_000_000).alias("right"))
    failed = F.when(F.col("o_orderkey") % 5 == 0, "processing_failed").otherwise("same_event")
    prior = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("decision_id"), (F.col("o_orderkey") + 10_000_000).alias("left"), F.col("o_custkey").alias("right"), failed.alias("relation"), (F.col("o_orderkey") % 10 == 0).alias("is_retryable"))
    return E.retry_split(pairs, prior).select("left", "right", "source", "decision_id", F.when(F.col("source") != "retry", F.col("relation")).alias("relation"))


@query()
def event_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a few decisions have changed, from the events before."""
    items, before = _facts(spark, sf_dir).select("id", "published"), cut(_decided(spark, sf_dir).withColumn("relation", F.when(F.col("score") >= 0.6, "same_event").otherwise("different_event")).withColumn("confidence", F.lit(0.9)))
    changed = before.withColumn("relation", F.when(F.col("right") % 50 == 0, "uncertain").otherwise(F.col("relation")))
    return E.regroup(E.complete_link(items, before), items, before, changed)


@query("""WITH s AS (SELECT event_type AS symbol, ts, event_id AS arrival, date_trunc('minute', ts) AS minute, value FROM events),
k AS (SELECT *, max(ts) OVER (PARTITION BY symbol, minute ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s)
SELECT symbol, minute, count(*) AS samples, round(first(value ORDER BY ts), 6) AS bid_open, round(last(value ORDER BY ts), 6) AS bid_close, round(avg(value), 6) AS bid_mean, round(quantile_disc(value, 0.95), 6) AS spread_p95, round(least(1.0, count(*) / 60), 6) AS coverage
FROM k WHERE last IS NULL OR ts > last GROUP BY symbol, minute""")
def sample_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.col("value")
    rows = e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("arrival"), value.alias("bid"), (value + 1).alias("ask"), value.alias("spread_bps"), F.lit(0.0).alias("imbalance"))
    return rounded(D.minutes(rows).select("symbol", F.col("minute").cast("timestamp_ntz").alias("minute"), "samples", "bid_open", "bid_close", "bid_mean", "spread_p95", "coverage"))


@query("""WITH u AS (SELECT event_type AS symbol, ts, value FROM events),
b AS (SELECT symbol, unnest(generate_series(date_trunc('second', min(ts)), date_trunc('second', max(ts)), INTERVAL 1 MINUTE)) AS ts FROM u GROUP BY symbol)
SELECT b.symbol, b.ts, round(u.value, 6) AS value, u.ts AS seen FROM b ASOF JOIN u ON b.symbol = u.symbol AND b.ts >= u.ts""")
def sample_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "value")
    return rounded(D.sample_and_hold(updates, "1 MINUTE"))


@query(f"SELECT {_BARS} FROM ({_bars_sql('hour', 'event_type')})")
def stream_minute_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by a stream over the events file, as a batch gives them."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    buy = F.when(F.col("event_type").isin("view", "purchase"), F.col("value")).otherwise(0.0)
    trades = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), buy.alias("buy"))
    done = minutes.drain(spark, minutes.stream_bars(trades, "1 hour"), "complete")
    return rounded(done.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
