"""Queries that read recorded payloads: each table is written as the text that a source answers with, and parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketweave.functions import html
from marketweave.plans.series import rounded
from marketweave.session import table
from marketweave.sources import payloads as P

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _millis(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp"))


def _text(x: Column) -> Column:
    return x.cast("string")


def _lists(rows: DataFrame, key: Column, item: Column, around: tuple[str, str] = ("", "")) -> DataFrame:
    """One JSON list of items per key, as a response."""
    body = F.to_json(F.collect_list(item))
    return rows.groupBy(key.alias("page")).agg(F.concat(F.lit(around[0]), body, F.lit(around[1])).alias("payload"))


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@query("""SELECT user_id AS page, date_trunc('millisecond', ts) AS open_time, date_trunc('millisecond', ts) + INTERVAL 59999 MILLISECOND AS close_time, max(event_id) AS trades, round(arg_max(value, event_id), 2) AS close
FROM events WHERE value IS NOT NULL AND date_trunc('millisecond', ts) + INTERVAL 59999 MILLISECOND < TIMESTAMP '2024-01-25' AND event_id % 10 > 0 AND event_id IN (SELECT max(event_id) FROM events WHERE event_id % 10 > 0 AND value IS NOT NULL GROUP BY user_id, date_trunc('millisecond', ts)) GROUP BY ALL""")
def kline_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional arrays of candles: every tenth is too short, those from the 25th on aren't closed."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("at", _millis(F.col("ts")))
    e = e.withColumn("last", F.max(F.when(F.col("event_id") % 10 > 0, F.col("event_id"))).over(Window.partitionBy("user_id", "at")))
    e = e.where((F.col("event_id") == F.col("last")) | (F.col("event_id") % 10 == 0))
    price = _text(F.round("value", 2))
    whole = F.array(_text(F.col("at")), price, price, price, price, F.lit("1"), _text(F.col("at") + 59_999), F.lit("2"), _text(F.col("event_id")), F.lit("3"), F.lit("4"), F.lit("0"))
    pages = _lists(e, F.col("user_id"), F.when(F.col("event_id") % 10 == 0, F.slice(whole, 1, 5)).otherwise(whole))
    found = P.klines(pages, F.lit("2024-01-25 00:00:00").cast("timestamp"))
    return rounded(_ntz(found.select("page", "open_time", "close_time", "trades", F.col("close").cast("double").alias("close")), "open_time", "close_time"))


@query("""SELECT o_custkey AS page, o_orderpriority AS symbol, o_orderdate::TIMESTAMP AS ts, round(o_totalprice, 2) AS open_interest, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey::DOUBLE END AS value FROM orders""")
def open_interest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open interest; every fifth value isn't a number."""
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.col("o_orderpriority").alias("symbol"), _text(F.round("o_totalprice", 2)).alias("sumOpenInterest"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(_text(F.col("o_orderkey"))).alias("sumOpenInterestValue"), _millis(F.col("o_orderdate")).alias("timestamp"))
    found = P.open_interest(_lists(o, F.col("o_custkey"), item))
    return rounded(_ntz(found.select("page", "symbol", "ts", F.col("open_interest").cast("double").alias("open_interest"), F.col("value").cast("double").alias("value")), "ts"))


@query("""SELECT o_custkey AS page, o_orderpriority AS symbol, o_orderdate::TIMESTAMP AS ts, o_orderkey / 8.0 AS rate, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey::DOUBLE END AS mark_price, left(repeat(o_orderstatus, 50), 40) AS kind FROM orders""")
def funding_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding rates: empty mark prices are null, kinds are cut to 40 characters."""
    k = F.col("o_orderkey")
    item = F.struct(F.col("o_orderpriority").alias("symbol"), _millis(F.col("o_orderdate")).alias("fundingTime"), _text((k / 8).cast("decimal(20,6)")).alias("fundingRate"), F.when(k % 3 == 0, "").otherwise(_text(k)).alias("markPrice"), F.repeat("o_orderstatus", F.lit(50)).alias("rateType"))
    found = P.funding(_lists(table(spark, sf_dir, "orders"), F.col("o_custkey"), item))
    return rounded(_ntz(found.select("page", "symbol", "ts", F.col("rate").cast("double").alias("rate"), F.col("mark_price").cast("double").alias("mark_price"), "kind"), "ts"))


@query("""SELECT o_custkey AS page, o_orderdate::TIMESTAMP AS open_time, o_orderkey::DOUBLE AS open, o_orderkey + 2.0 AS high, o_orderkey - 2.0 AS low, o_orderkey + 1.0 AS close FROM orders""")
def volatility_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    item = F.array(*[x.cast("double") for x in (_millis(F.col("o_orderdate")), k, k + 2, k - 2, k + 1)])
    return rounded(_ntz(P.volatility_index(_lists(table(spark, sf_dir, "orders"), F.col("o_custkey"), item, ('{"result":{"data":', "}}"))), "open_time"))


@query("""SELECT o_custkey AS page, o_orderkey AS instrument_id, 'O-' || o_orderkey AS instrument_name, (o_orderkey % 7)::DOUBLE AS strike, o_orderdate::TIMESTAMP AS expiration_time FROM orders WHERE o_orderkey % 7 > 0""")
def instrument_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option instruments; those without a strike are dropped."""
    k = F.col("o_orderkey")
    item = F.struct(k.alias("instrument_id"), F.concat(F.lit("O-"), _text(k)).alias("instrument_name"), (k % 7).cast("double").alias("strike"), F.lit(1.0).alias("contract_size"), _millis(F.col("o_orderdate")).alias("expiration_timestamp"))
    found = P.option_instruments(_lists(table(spark, sf_dir, "orders"), F.col("o_custkey"), item, ('{"result":', "}")))
    return rounded(_ntz(found.select("page", "instrument_id", "instrument_name", "strike", "expiration_time"), "expiration_time"))


@query("""SELECT o_custkey AS page, 'O-' || o_orderkey AS instrument_name, (o_orderkey % 9 - 1)::DOUBLE AS open_interest, o_orderdate::TIMESTAMP AS source_time FROM orders WHERE o_orderkey % 9 > 0""")
def summary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option summaries; those with negative open interest are dropped."""
    k = F.col("o_orderkey")
    item = F.struct(F.concat(F.lit("O-"), _text(k)).alias("instrument_name"), (k % 9 - 1).cast("double").alias("open_interest"), _millis(F.col("o_orderdate")).alias("creation_timestamp"))
    found = P.option_summaries(_lists(table(spark, sf_dir, "orders"), F.col("o_custkey"), item, ('{"result":', "}")))
    return rounded(_ntz(found.select("page", "instrument_name", "open_interest", "source_time"), "source_time"))


@query("""WITH d AS (SELECT DISTINCT o_custkey AS page, o_orderdate::DATE AS day FROM orders)
SELECT page, day, (date_diff('day', DATE '1970-01-01', day))::DOUBLE AS supply, date_diff('day', DATE '1970-01-01', day) + 1.0 AS supply_usd, page % 2 = 1 AND count(*) OVER (PARTITION BY page) > 1 AS rejected FROM d""")
def supply_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily supplies; lists of every second customer run backward and are rejected."""
    days = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("n")).distinct()
    amount = lambda x: F.struct(x.cast("double").alias("peggedUSD"))
    item = F.struct((F.col("n") * 86_400).alias("date"), amount(F.col("n")).alias("totalCirculating"), amount(F.col("n") + 1).alias("totalCirculatingUSD"))
    sorted_ = F.sort_array(F.collect_list(item))
    pages = days.groupBy("page").agg(F.to_json(F.when(F.col("page") % 2 == 1, F.reverse(sorted_)).otherwise(sorted_)).alias("payload"))
    return rounded(P.supply_chart(pages).select("page", "day", "supply", "supply_usd", "rejected"))


@query("""SELECT c_custkey AS page, DATE '2024-03-01' + d::INT AS day, t AS ticker, CASE t WHEN 'AAA' THEN CASE WHEN (c_custkey + d) % 3 = 0 THEN NULL ELSE (c_custkey + d) * 1e6 END WHEN 'BBB' THEN -(c_custkey % 50) * 1e6 ELSE (d + 1) * 1e6 END AS flow, t = 'TOTAL' AS is_total
FROM customer, (SELECT unnest([0, 1]) AS d), (SELECT unnest(['AAA', 'BBB', 'TOTAL']) AS t)""")
def flow_table_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables of daily flows of funds: dashes for none, brackets for outflows, a total at the end."""
    k = F.col("c_custkey")
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    day = lambda d: row(F.lit(f"0{d + 1} Mar 2024"), F.when((k + d) % 3 == 0, "-").otherwise(_text(k + d)), F.concat(F.lit("("), _text(k % 50), F.lit(".0)")), F.lit(f"{d + 1}"))
    head = row(F.lit(""), F.lit("AAA"), F.lit("BBB"), F.lit(""))
    page = F.concat(F.lit("<html><p>Flows</p><table>"), head, row(F.lit("Fee"), F.lit("0.2%"), F.lit("0.3%"), F.lit("")), day(0), day(1), F.lit("</table></html>"))
    found = P.flow_table(table(spark, sf_dir, "customer").select(k.alias("page"), page.alias("payload")))
    return rounded(found.select("page", "day", "ticker", F.col("flow").cast("double").alias("flow"), "is_total"))


@query("""SELECT n_nationkey AS page, r AS rank, '0x' || lpad(lower(to_hex(n_nationkey * 100 + r)), 40, '0') AS address, r * 1234.5 AS balance FROM nation, (SELECT unnest([1, 2, 3]) AS r)""")
def account_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables of addresses with their ranks and balances."""
    k = F.col("n_nationkey")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    line = lambda r: F.concat(F.lit("<tr>"), cell(F.lit(str(r))), cell(F.concat(F.lit("<a href='#'>0x"), F.lpad(F.hex(k * 100 + r), 40, "0"), F.lit("</a>"))), cell(F.lit(f"{r * 1234.5:,} ETH")), F.lit("</tr>"))
    page = F.concat(F.lit("<table><tr><th>Rank</th><th>Address</th><th>Balance</th></tr>"), line(1), line(2), line(3), F.lit("</table>"))
    return rounded(P.accounts_table(table(spark, sf_dir, "nation").select(k.alias("page"), page.alias("payload"))).select("page", "rank", "address", "balance"))


@query("""SELECT o_custkey AS page, 'g' || o_orderkey AS item_id, 'https://x.org/' || o_orderkey || '?a=1&b=2' AS url, 'Order & ' || o_orderkey AS title, o_orderdate::TIMESTAMP AS published, o_orderstatus || ',fresh' AS tags FROM orders WHERE o_orderkey % 6 > 0""")
def feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS documents with bare ampersands; entries without a link are dropped."""
    k = F.col("o_orderkey")
    link = F.when(k % 6 > 0, F.concat(F.lit("<link>https://x.org/"), _text(k), F.lit("?a=1&b=2</link>"))).otherwise("")
    at = F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item><guid>g"), _text(k), F.lit("</guid><title>Order & "), _text(k), F.lit("</title>"), link, F.lit("<category>"), F.col("o_orderstatus"), F.lit("</category><pubDate>"), at, F.lit("</pubDate></item>"))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("payload"))
    return _ntz(P.feed(pages, "fresh").select("page", "item_id", "url", "title", "published", F.array_join("tags", ",").alias("tags")), "published")


@query("""SELECT o_custkey AS page, 'Status ' || o_orderstatus AS category, o_orderkey::VARCHAR AS item_id, 'c' || o_orderkey AS code, o_orderdate::TIMESTAMP AS published FROM orders WHERE o_custkey % 4 > 0""")
def announcement_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements in lists of lists; answers of another code have none."""
    k = F.col("o_orderkey")
    article = F.struct(k.alias("id"), F.concat(F.lit("c"), _text(k)).alias("code"), F.lit("T").alias("title"), F.lit(1).alias("type"), _millis(F.col("o_orderdate")).alias("releaseDate"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(article).alias("articles"))
    catalog = F.struct(F.lit(1).cast("bigint").alias("catalogId"), F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("catalogName"), F.lit(9).cast("bigint").alias("total"), "articles")
    body = F.struct(F.when(F.col("page") % 4 > 0, "000000").otherwise("000001").alias("code"), F.struct("catalogs").alias("data"))
    pages = lists.groupBy(F.col("o_custkey").alias("page")).agg(F.collect_list(catalog).alias("catalogs")).select("page", F.to_json(body).alias("payload"))
    return _ntz(P.announcements(pages).select("page", "category", "item_id", "code", "published"), "published")


@query("""SELECT o_custkey AS page, o_orderkey::VARCHAR AS item_id, 'A & B ' || o_orderkey AS title, o_orderstatus AS summary, o_orderdate::TIMESTAMP AS published, 'News,' || o_orderpriority AS tags FROM orders WHERE o_orderkey % 5 > 0""")
def post_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of a blog with marked-up titles; those without a link are dropped."""
    k = F.col("o_orderkey")
    html_ = lambda *x: F.struct(F.concat(*x).alias("rendered"))
    term = lambda name, kind: F.array(F.struct(name.alias("name"), F.lit(kind).alias("taxonomy")))
    terms = F.struct(F.array(term(F.lit("News"), "category"), term(F.col("o_orderpriority"), "post_tag")).alias("wp:term"))
    item = F.struct(k.alias("id"), F.when(k % 5 > 0, "https://x.org").otherwise("").alias("link"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date_gmt"), html_(F.lit("A &amp; <b>B</b> "), _text(k)).alias("title"), html_(F.lit("<p>"), F.col("o_orderstatus"), F.lit("</p>")).alias("excerpt"), terms.alias("_embedded"))
    found = P.posts(_lists(table(spark, sf_dir, "orders"), F.col("o_custkey"), item))
    return _ntz(found.select("page", "item_id", "title", "summary", "published", F.array_join("tags", ",").alias("tags")), "published")


@query("""SELECT o_custkey AS page, o_orderdate::DATE AS day, 'Bridge ' || o_orderkey AS target, 'It & all' AS description, '$ ' || o_orderkey AS loss, 'https://x.org/' || o_orderkey AS reference FROM orders WHERE o_orderkey % 4 > 0""")
def incident_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of incidents; those without a day are dropped."""
    k = F.col("o_orderkey")
    day = F.when(k % 4 > 0, F.concat(F.lit("<span class='time'>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</span>"))).otherwise("")
    card = F.concat(F.lit("<li>"), day, F.lit("<h3><em>Hacked target: </em>Bridge "), _text(k), F.lit("</h3><p><em>Description of the event: </em>It &amp; all</p><p><span><em>Amount of loss: </em>$ "), _text(k), F.lit("</span></p><a href='https://x.org/"), _text(k), F.lit("'>ref</a></li>"))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(card), ""), F.lit("</ul>")).alias("payload"))
    return P.incidents(pages).select("page", "day", "target", "description", "loss", "reference")


@query("""SELECT o_custkey AS page, o_orderdate::DATE AS day, 'Title ' || o_orderkey AS title, o_orderstatus AS summary, 'https://x.org/p/' || o_orderkey AS url FROM orders WHERE o_orderkey % 4 > 0""")
def press_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a press room; those without a summary are dropped."""
    k = F.col("o_orderkey")
    body = F.when(k % 4 > 0, F.concat(F.lit("<p class='paragraph-body'>"), F.col("o_orderstatus"), F.lit("</p>"))).otherwise("")
    card = F.concat(F.lit("<div role='listitem'><a href='/p/"), _text(k), F.lit("'><p class='caption-disclosure'>"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</p><p class='h6'>Title "), _text(k), F.lit("</p>"), body, F.lit("</a></div>"))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.concat(F.lit("<main>"), F.array_join(F.collect_list(card), ""), F.lit("</main>")).alias("payload"))
    return P.press_releases(pages, "https://x.org").select("page", "day", "title", "summary", "url")


@query("""SELECT event_type AS symbol, date_trunc('millisecond', ts) AS ts, (event_id % 90)::DOUBLE AS taker_buy, (100 - event_id % 90)::DOUBLE AS taker_sell, event_id % 2 = 0 AS closed FROM events WHERE event_type = 'view' AND event_id % 5 > 1""")
def message_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a stream: candles, books, other kinds and broken ones, of all symbols; candles of one are kept."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    k = F.struct(_millis(F.col("ts")).alias("t"), F.lit("1").alias("o"), F.lit("2").alias("h"), F.lit("1").alias("l"), F.lit("2").alias("c"), F.lit("100").alias("q"), _text(n % 90).alias("Q"), (n % 2 == 0).alias("x"))
    whole = F.to_json(F.struct(F.when(n % 5 == 1, "other").otherwise("kline").alias("e"), _millis(F.col("ts")).alias("E"), F.col("event_type").alias("s"), k.alias("k")))
    raw = e.select(F.when(n % 5 == 0, F.concat(F.lit("{"), whole)).when(n % 2 == 0, F.concat(F.lit('{"stream":"x","data":'), whole, F.lit("}"))).otherwise(whole).alias("payload"))
    candles, _, _ = P.messages(raw, "view")
    return rounded(_ntz(candles.select("symbol", "ts", "taker_buy", "taker_sell", "closed"), "ts"))


@query("""SELECT doc_id, 'Heading of document ' || doc_id || ' that is read' || chr(10) || chr(10) || 'The body of document ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ' goes on for long enough, so that this article has its one hundred and twenty characters.' ELSE ' stands outside of what the page calls its article.' END AS text FROM documents""")
def article_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with articles of their own (every third), or blocks outside; menus, scripts, short and repeated blocks don't count."""
    n = _text(F.col("doc_id"))
    head = F.concat(F.lit("<h1>Heading of document "), n, F.lit(" that is read</h1>"))
    own = F.concat(F.lit("<article>"), head, F.lit("<p>The body of document "), n, F.lit(" goes on for long enough, so that this article has its one hundred and twenty characters.</p><p>too short</p></article><p>a block outside that isn't read</p>"))
    other = F.concat(F.lit("<article><p>a short article of the page</p></article>"), head, F.lit("<p>The body of document "), n, F.lit(" stands outside of what the page calls its article.</p><p>THE BODY OF DOCUMENT "), n, F.lit(" STANDS OUTSIDE of what the page calls its article.</p>"))
    page = F.concat(F.lit("<html><head><script>p('<p>no text of the page at all</p>')</script></head><nav><li>a menu entry of the page</li></nav>"), F.when(F.col("doc_id") % 3 == 0, own).otherwise(other), F.lit("</html>"))
    return table(spark, sf_dir, "documents").select("doc_id", html.article_text(page).alias("text"))
