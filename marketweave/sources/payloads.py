"""Typed rows from recorded payloads: candles, derivatives, options, supplies, flows, feeds, messages.

Every function takes a DataFrame with the raw text in column `payload` (one response or message per
row, as spark.read.text(wholetext=True) or a stream gives it) and leaves further columns in place.
A value that can't be read is null; `rejected` tells rows that break their schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.html import cards, feed_entries, plain_text, tables
from marketweave.functions.numeric import flow_value
from marketweave.functions.timegrid import parse_when

# told to be so, as a filter that Spark infers from explode would parse each page once more, before the pages are dealt
cards, tables = cards.asNondeterministic(), tables.asNondeterministic()

DECIMAL = "decimal(38,18)"
#: Tasks that parse markup, by cores of the session.
TASKS_A_CORE = 4
CHART = "array<struct<date: bigint, totalCirculating: struct<peggedUSD: double>, totalCirculatingUSD: struct<peggedUSD: double>, totalMintedUSD: struct<peggedUSD: double>>>"
ANNOUNCEMENTS = "struct<code: string, data: struct<catalogs: array<struct<catalogId: bigint, catalogName: string, total: bigint, articles: array<struct<id: bigint, code: string, title: string, type: int, releaseDate: bigint>>>>>>"


def _dealt(df: DataFrame) -> DataFrame:
    """df dealt to several tasks a core: markup is few bytes but much work, so files and adaptive shuffles would leave it in few tasks."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def _keep(df: DataFrame, rows: Column) -> DataFrame:
    """df without payload, a row per element of `rows` as column r."""
    keep = [c for c in df.columns if c != "payload"]
    return df.select(*keep, rows.alias("__rows")).select(*keep, F.explode("__rows").alias("r"))


def klines(df: DataFrame, now: Column) -> DataFrame:
    """Candles of positional arrays; unclosed, short and repeated ones are dropped."""
    rows = _keep(df, F.from_json("payload", "array<array<string>>")).where(F.size("r") >= 11)
    at = lambda i: F.get("r", i)
    names = {1: "open", 2: "high", 3: "low", 4: "close", 5: "volume", 7: "quote_volume", 9: "taker_buy_volume", 10: "taker_buy_quote"}
    out = rows.select(*[c for c in rows.columns if c != "r"], F.timestamp_millis(at(0).try_cast("bigint")).alias("open_time"), F.timestamp_millis(at(6).try_cast("bigint")).alias("close_time"), *[at(i).try_cast(DECIMAL).alias(n) for i, n in names.items()], at(8).try_cast("bigint").alias("trades"))
    return out.where(F.col("close_time") < now).dropDuplicates([c for c in out.columns if c in df.columns] + ["open_time"])


def open_interest(df: DataFrame) -> DataFrame:
    rows = _keep(df, F.from_json("payload", "array<struct<symbol: string, sumOpenInterest: string, sumOpenInterestValue: string, timestamp: bigint>>"))
    return rows.select(*[c for c in rows.columns if c != "r"], "r.symbol", F.timestamp_millis("r.timestamp").alias("ts"), F.col("r.sumOpenInterest").try_cast(DECIMAL).alias("open_interest"), F.col("r.sumOpenInterestValue").try_cast(DECIMAL).alias("value"))


def funding(df: DataFrame) -> DataFrame:
    """Funding rates; an empty mark price is null, the kind is cut to 40 characters."""
    rows = _keep(df, F.from_json("payload", "array<struct<symbol: string, fundingTime: bigint, fundingRate: string, markPrice: string, rateType: string>>"))
    return rows.select(*[c for c in rows.columns if c != "r"], "r.symbol", F.timestamp_millis("r.fundingTime").alias("ts"), F.col("r.fundingRate").try_cast(DECIMAL).alias("rate"), F.nullif("r.markPrice", F.lit("")).try_cast(DECIMAL).alias("mark_price"), F.substring("r.rateType", 1, 40).alias("kind"))


def volatility_index(df: DataFrame) -> DataFrame:
    """Index candles [ms, open, high, low, close] of {result: {data}}."""
    rows = _keep(df, F.from_json("payload", "struct<result: struct<data: array<array<double>>>>")["result"]["data"])
    value = lambda i: F.get("r", i)
    return rows.select(*[c for c in rows.columns if c != "r"], F.timestamp_millis(value(0).cast("bigint")).alias("open_time"), *[value(i).alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"))])


def option_instruments(df: DataFrame) -> DataFrame:
    schema = "struct<result: array<struct<instrument_id: bigint, instrument_name: string, base_currency: string, option_type: string, strike: double, expiration_timestamp: bigint, creation_timestamp: bigint, contract_size: double, is_active: boolean, state: string>>>"
    rows = _keep(df, F.from_json("payload", schema)["result"])
    out = rows.select(*[c for c in rows.columns if c != "r"], "r.*")
    return out.withColumns({"expiration_time": F.timestamp_millis("expiration_timestamp"), "creation_time": F.timestamp_millis("creation_timestamp")}).drop("expiration_timestamp", "creation_timestamp").where("strike > 0 AND contract_size > 0")


def option_summaries(df: DataFrame) -> DataFrame:
    schema = "struct<result: array<struct<instrument_name: string, creation_timestamp: bigint, underlying_price: double, mark_price: double, mark_iv: double, bid_price: double, ask_price: double, mid_price: double, last: double, open_interest: double, volume: double, volume_usd: double, interest_rate: double>>>"
    rows = _keep(df, F.from_json("payload", schema)["result"])
    out = rows.select(*[c for c in rows.columns if c != "r"], "r.*").withColumn("source_time", F.timestamp_millis("creation_timestamp")).drop("creation_timestamp")
    return out.where("coalesce(open_interest, 0) >= 0 AND coalesce(mark_iv, 0) >= 0")


def supply_chart(df: DataFrame) -> DataFrame:
    """Daily supplies; rejected where a date doesn't follow the one before it or a value is negative."""
    chart = df.withColumn("c", F.from_json("payload", CHART))
    increasing = F.forall(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), lambda a, b: b.isNull() | a.isNull() | (a["date"] < b["date"])), lambda ok: ok)
    positive = F.forall("c", lambda x: (x["totalCirculating"]["peggedUSD"] >= 0) & (x["totalCirculatingUSD"]["peggedUSD"] >= 0))
    rows = chart.withColumn("rejected", ~F.coalesce(increasing & positive, F.lit(False)))
    keep = [c for c in df.columns if c != "payload"]
    return rows.select(*keep, "rejected", F.explode("c").alias("r")).select(*keep, "rejected", F.to_date(F.timestamp_seconds("r.date")).alias("day"), F.col("r.totalCirculating.peggedUSD").alias("supply"), F.col("r.totalCirculatingUSD.peggedUSD").alias("supply_usd"), F.col("r.totalMintedUSD.peggedUSD").alias("minted_usd"))


def flow_table(df: DataFrame) -> DataFrame:
    """(day, ticker, flow, raw, is_total) of the first table with a header row of tickers, by unpivoting it."""
    keep = [c for c in df.columns if c != "payload"]
    ticker = "^[A-Z][A-Z0-9.]{1,9}$"
    header = lambda r: (F.size(r) >= 4) & (F.get(r, 0) == "") & (F.get(r, F.size(r) - 1) == "") & F.forall(F.slice(r, 2, F.greatest(F.size(r) - 2, F.lit(0))), lambda x: x.rlike(ticker))
    with_table = _dealt(df).withColumn("t", F.get(F.filter(tables("payload"), lambda t: F.exists(t, header)), 0))
    rows = with_table.withColumn("h", F.get(F.filter("t", header), 0)).select(*keep, "h", F.explode("t").alias("r"))
    day = F.to_date(F.try_to_timestamp(F.get("r", 0), F.lit("dd MMM yyyy")))
    dated = rows.withColumn("day", day).where((F.size("r") == F.size("h")) & F.col("day").isNotNull())
    cells = dated.select(*keep, "day", F.size("r").alias("n"), "h", F.posexplode("r").alias("i", "raw")).where("i > 0")
    total = F.col("i") == F.col("n") - 1
    return cells.select(*keep, "day", F.when(total, "TOTAL").otherwise(F.get("h", F.col("i"))).alias("ticker"), flow_value(F.col("raw")).alias("flow"), "raw", total.alias("is_total"))


def accounts_table(df: DataFrame) -> DataFrame:
    """(rank, address, balance) of a table of addresses; rejected where ranks have gaps."""
    keep = [c for c in df.columns if c != "payload"]
    rows = _dealt(df).select(*keep, F.flatten(tables("payload")).alias("__rows")).select(*keep, F.explode("__rows").alias("r")).where((F.size("r") >= 3) & F.get("r", 0).rlike("^[0-9]+$"))
    address = F.regexp_extract(F.array_join("r", " "), r"(0x[0-9a-fA-F]{40})", 1)
    balance = F.regexp_replace(F.regexp_extract(F.array_join("r", "|"), r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:ETH|Ether)", 1), ",", "").try_cast("double")
    found = rows.select(*keep, F.get("r", 0).cast("int").alias("rank"), F.lower(address).alias("address"), balance.alias("balance")).where("address <> ''")
    return found


def feed(df: DataFrame, category: str = "") -> DataFrame:
    """News items of RSS or Atom documents."""
    keep = [c for c in df.columns if c != "payload"]
    rows = _dealt(df).select(*keep, F.explode(feed_entries("payload")).alias("r"))
    first = lambda *names: F.coalesce(*[F.nullif(F.col("r")[n], F.lit("")) for n in names])
    many = F.when(F.startswith(first("category"), F.lit("[")), F.from_json(first("category"), "array<string>")).otherwise(F.array_compact(F.array(first("category"))))
    tags = F.array_distinct(F.concat(many, F.array(F.lit(category)))) if category else F.array_distinct(many)
    return rows.select(*keep, first("guid", "id").alias("item_id"), first("link").alias("url"), first("title").alias("title"), first("description", "summary", "content").alias("summary"), parse_when(first("pubdate", "published", "updated")).alias("published"), first("creator", "author").alias("author"), tags.alias("tags"))


def announcements(df: DataFrame) -> DataFrame:
    """Articles of announcement lists: two levels of lists."""
    keep = [c for c in df.columns if c != "payload"]
    body = F.from_json("payload", ANNOUNCEMENTS)
    catalogs = df.withColumn("b", body).where(F.col("b.code") == "000000").select(*keep, F.explode("b.data.catalogs").alias("g"))
    rows = catalogs.where("g.catalogId IS NOT NULL AND g.articles IS NOT NULL").select(*keep, F.col("g.catalogName").alias("category"), F.explode("g.articles").alias("r"))
    return rows.select(*keep, "category", F.col("r.id").cast("string").alias("item_id"), F.col("r.code").alias("code"), F.col("r.title").alias("title"), F.timestamp_millis("r.releaseDate").alias("published"))


POSTS = "array<struct<id: bigint, link: string, date_gmt: string, modified_gmt: string, title: struct<rendered: string>, excerpt: struct<rendered: string>, _embedded: struct<`wp:term`: array<array<struct<name: string, taxonomy: string>>>, author: array<struct<name: string>>>>>"


def posts(df: DataFrame) -> DataFrame:
    """News items of a blog's JSON list; a post without id, link or title is dropped."""
    rows = _keep(df, F.from_json("payload", POSTS))
    terms = F.flatten(F.coalesce("r._embedded.`wp:term`", F.array().cast("array<array<struct<name: string, taxonomy: string>>>")))
    of = lambda kind: F.transform(F.filter(terms, lambda t: t["taxonomy"] == kind), lambda t: t["name"])
    out = rows.select(
        *[c for c in rows.columns if c != "r"],
        F.col("r.id").cast("string").alias("item_id"),
        F.col("r.link").alias("url"),
        plain_text("r.title.rendered").alias("title"),
        plain_text("r.excerpt.rendered").alias("summary"),
        parse_when(F.col("r.date_gmt")).alias("published"),
        parse_when(F.col("r.modified_gmt")).alias("updated"),
        F.get("r._embedded.author", 0)["name"].alias("author"),
        F.array_distinct(F.concat(of("category"), of("post_tag"))).alias("tags"),
    )
    return out.where("item_id IS NOT NULL AND url <> '' AND title <> ''")


def _part(kind: str) -> Column:
    """Text of a card's first part of a kind."""
    return F.get(F.filter("r.parts", lambda p: F.contains(p["kind"], F.lit(kind))), 0)["text"]


def incidents(df: DataFrame) -> DataFrame:
    """Incident cards: day, target, description, loss, method and reference; cards without a day or target are dropped."""
    rows = _keep(_dealt(df), cards("payload"))
    whole = F.array_join(F.transform("r.parts", lambda p: p["text"]), "\n")
    said = lambda label: F.nullif(F.trim(F.regexp_extract(whole, rf"(?m)^{label}:\s*(.*)$", 1)), F.lit(""))
    out = rows.select(*[c for c in rows.columns if c != "r"], F.to_date(F.try_to_timestamp(_part("time"), F.lit("yyyy-MM-dd"))).alias("day"), said("Hacked target").alias("target"), said("Description of the event").alias("description"), said("Amount of loss").alias("loss"), said("Attack method").alias("method"), F.nullif("r.href", F.lit("")).alias("reference"))
    return out.where("day IS NOT NULL AND target IS NOT NULL")


def press_releases(df: DataFrame, base: str = "") -> DataFrame:
    """Cards of a press room: day, title, summary and link; cards that lack one are dropped."""
    rows = _keep(_dealt(df), cards("payload"))
    out = rows.select(*[c for c in rows.columns if c != "r"], F.to_date(F.try_to_timestamp(_part("caption"), F.lit("MMMM d, yyyy"))).alias("day"), _part("h6").alias("title"), _part("paragraph").alias("summary"), F.concat(F.lit(base), "r.href").alias("url"))
    return out.where("day IS NOT NULL AND title IS NOT NULL AND summary IS NOT NULL")


def messages(df: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stream messages as (candles, books, rejected): by kind, of one symbol; works on batches and streams."""
    raw = F.coalesce(F.get_json_object("payload", "$.data"), F.col("payload"))
    kind = F.get_json_object(raw, "$.e")
    told = df.withColumns({"__raw": raw, "__kind": kind, "__symbol": F.get_json_object(raw, "$.s")})
    own = F.coalesce(F.col("__symbol") == symbol, F.lit(False))
    # paths tell upper from lower case, which struct fields don't
    at = lambda path: F.get_json_object("__raw", f"$.{path}")
    number = lambda name: at(f"k.{name}").try_cast("double")
    when = lambda path: F.timestamp_millis(at(path).try_cast("bigint"))
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "q": "quote_volume", "Q": "taker_buy"}
    candles = told.where(own & (F.col("__kind") == "kline")).select(F.col("__symbol").alias("symbol"), when("k.t").alias("ts"), when("E").alias("arrival"), *[number(k).alias(v) for k, v in names.items()], (number("q") - number("Q")).alias("taker_sell"), (number("Q") * 2 - number("q")).alias("delta"), at("k.x").try_cast("boolean").alias("closed"))
    levels = lambda side: F.from_json(at(side), "array<array<string>>")
    books = told.where(own & (F.col("__kind") == "depthUpdate")).select(F.col("__symbol").alias("symbol"), when("E").alias("ts"), levels("b").alias("bids"), levels("a").alias("asks"))
    rejected = told.where(~(own & F.coalesce(F.col("__kind").isin("kline", "depthUpdate"), F.lit(False)))).drop("__raw", "__kind", "__symbol")
    return candles, books, rejected
