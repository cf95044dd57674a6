"""Text, payloads, events and streams."""

import datetime as dt
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marketweave.functions import html, text
from marketweave.operators import events as E
from marketweave.operators import news as N
from marketweave.plans import news
from marketweave.sources import paged, payloads
from marketweave.streaming import minutes


def one(spark, value, **more):
    return spark.createDataFrame([(value,)], "payload string").withColumns({k: F.lit(v) for k, v in more.items()})


def test_urls(spark):
    rows = [("HTTPS://Example.COM/a/b/?utm_source=x&b=2&GCLID=1#top", "https://example.com/a/b?b=2"), ("http://x.org", "http://x.org/"), ("", ""), (None, "")]
    df = spark.createDataFrame(rows, "url string, want string").select(text.canonical_url(F.col("url")).alias("a"), text.canonical_url_exact("url").alias("b"), "want")
    assert all(r["a"] == r["want"] == r["b"] for r in df.collect())


def test_tokens_and_evidence(spark):
    df = spark.createDataFrame([("The ETH Update: 2026 hack, hack of Bridge-X",)], "t string")
    assert sorted(df.select(text.significant_tokens(F.col("t")).alias("x")).first()["x"]) == ["bridge", "eth", "hack"]
    cases = [("b c", "a b c", "", "", "title:exact"), ("b  c", "", "a b c", "", "summary:normalized"), ("b c", "x", "y", "a b c", "body:exact"), ("no", "x", "y", "z", None), ("", "x", "", "", None)]
    df = spark.createDataFrame([c[:4] for c in cases], "q string, t string, s string, b string")
    assert [r["m"] for r in df.select(text.evidence(*map(F.col, "qtsb")).alias("m")).collect()] == [c[4] for c in cases]


def test_evidences_of_many_quotes(spark):
    cases = [("b c", "a b c", "", "", "title:exact"), ("b  c", None, "a b c", "b \t c", "summary:normalized"), ("b c", "x", "y", "a b c", "body:exact"), ("no", "x", "y", None, None), ("", "x", "", "", None)]
    df = spark.createDataFrame([c[:4] for c in cases], "q string, t string, s string, b string")
    many = df.select(text.evidences(F.array(F.col("q"), F.lit(None), F.lit(" "), F.col("q")), *map(F.col, "tsb")).alias("m"))
    assert [r["m"] for r in many.collect()] == [[c[4], None, None, c[4]] for c in cases]


def test_summary_and_similarity(spark):
    long = "One sentence here. " * 40
    r = spark.createDataFrame([(long, "abcd", "bcde")], "t string, a string, b string").select(text.summary(F.col("t")).alias("s"), text.summary(F.lit("x" * 700)).alias("c"), text.summary(F.lit(" a  b ")).alias("k"), text.sequence_ratio("a", "b").alias("r")).first()
    assert r["s"].endswith("here.") and 300 < len(r["s"]) <= 601 and r["c"] == "x" * 600 + "…" and r["k"] == "a b" and r["r"] == 0.75


def test_title_rules(spark):
    rows = [("SEC approves spot Ether ETF", False, False, "bullish"), ("ETH  ETF denied", False, False, "bearish"), ("Word of the Day", True, False, "irrelevant"), ("Word of the Day", False, False, None), ("Rates", False, True, "unclear")]
    df = spark.createDataFrame([r[:3] for r in rows], "t string, e boolean, o boolean")
    assert [r["c"] for r in df.select(N.title_rule(F.col("t"), F.col("e"), F.col("o"))["conclusion"].alias("c")).collect()] == [r[3] for r in rows]


def test_dedup_by_tiers(spark):
    rows = [(1, "s", "a", "u"), (2, "s", "a", "v"), (3, "s", None, "u"), (4, "s", None, None), (5, "s", None, None), (6, "t", "a", "u")]
    got = N.dedup(spark.createDataFrame(rows, "n int, src string, item string, url string"), "src", ["item", "url"], "n")
    assert sorted(r["n"] for r in got.collect()) == [1, 4, 5, 6]


def test_html_and_tables(spark):
    page = "<html><head><meta name='description' content='short'><script>no()</script></head><body><nav><p>menu entry of the site here</p></nav><article><h1>A heading that is long enough</h1><p>First paragraph of the article, long enough &amp; more to reach the limit.</p><p>first paragraph of the ARTICLE, long enough &amp; more to reach the limit.</p><p>tiny</p></article><p>outside text that is long enough</p></body></html>"
    assert html.article(page).split("\n\n") == ["A heading that is long enough", "First paragraph of the article, long enough & more to reach the limit."]
    assert html.article("<meta name=description content='only this'>") == "only this" and html.article("") == ""
    again = "".join(f"<p>{x} text that stands here twice or once</p>" for x in ("One", "Two", "ONE"))
    assert html.article(again).split("\n\n") == ["One text that stands here twice or once", "Two text that stands here twice or once"]
    assert html.article("<p>a paragraph that is never closed<p>goes on in the next one</p></nav></li>") == "a paragraph that is never closed goes on in the next one"
    assert html.cells("<table><tr><td>a<td> b </td><tr></table><td>c</td>") == [[["b"], ["c"]]] and html.cells("</td><table><td>x</td>") == [[]]
    flows = "<table><tr><th></th><th></th><th></th><th>Total</th></tr><tr><th></th><th>ETHA</th><th>FETH</th><th></th></tr><tr><td>Fee</td><td>0.25%</td><td>0.25%</td><td></td></tr><tr><td>01 Aug 2026</td><td>10.0</td><td>(2.5)</td><td>7.5</td></tr><tr><td>02 Aug 2026</td><td>0.0</td><td>-</td><td>0.0</td></tr></table>"
    got = {(r["day"], r["ticker"]): (r["flow"], r["is_total"]) for r in payloads.flow_table(one(spark, flows)).collect()}
    first, second = dt.date(2026, 8, 1), dt.date(2026, 8, 2)
    assert got == {(first, "ETHA"): (10e6, False), (first, "FETH"): (-2.5e6, False), (first, "TOTAL"): (7.5e6, True), (second, "ETHA"): (0, False), (second, "FETH"): (None, False), (second, "TOTAL"): (0, True)}


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>https://x.org/1?a=1&b=2</link><guid>g1</guid><pubDate>Fri, 31 Jul 2026 22:30:00 +0000</pubDate><category>M</category><category>E</category></item><item><title>no link</title></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>T</title><link rel='alternate' href='https://x.org/2'/><id>i2</id><updated>2026-08-01T00:00:00Z</updated></entry></feed>"
    r = payloads.feed(one(spark, rss), "news").collect()
    assert len(r) == 1 and (r[0]["item_id"], r[0]["title"], r[0]["tags"]) == ("g1", "A & B", ["M", "E", "news"]) and r[0]["url"].endswith("a=1&b=2")
    assert r[0]["published"].isoformat().startswith("2026-07-31T22:30")
    a = payloads.feed(one(spark, atom)).first()
    assert (a["url"], a["item_id"], a["tags"]) == ("https://x.org/2", "i2", [])
    assert payloads.feed(one(spark, "<nonsense")).count() == 0


def test_posts_and_cards(spark):
    post = {"id": 5, "link": "https://x.org/5", "date_gmt": "2026-07-31T10:00:00", "title": {"rendered": "A &amp; <b>B</b>"}, "excerpt": {"rendered": "<p>s</p>"}, "_embedded": {"wp:term": [[{"name": "News", "taxonomy": "category"}], [{"name": "t", "taxonomy": "post_tag"}]], "author": [{"name": "N"}]}}
    r = payloads.posts(one(spark, json.dumps([post, {"id": 6, "link": "", "title": {"rendered": "x"}}]))).collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["summary"], r[0]["author"], r[0]["tags"]) == ("A & B", "s", "N", ["News", "t"])
    hacks = "<ul><li><span class='time'>2026-07-30</span><h3><em>Hacked target: </em>Bridge</h3><p><em>Description of the event: </em>It was exploited &amp; paused.</p><p><span><em>Amount of loss: </em>$ 1,250,000</span><span><em>Attack method: </em>Contract</span></p><p><a href='https://x.org/r'>ref</a></p></li><li><h3><em>Hacked target: </em>No day</h3></li></ul>"
    h = payloads.incidents(one(spark, hacks)).collect()
    assert len(h) == 1 and (h[0]["target"], h[0]["description"], h[0]["loss"], h[0]["method"], h[0]["reference"]) == ("Bridge", "It was exploited & paused.", "$ 1,250,000", "Contract", "https://x.org/r")
    press = "<main><div role='listitem'><a href='/p/1'><p class='caption-disclosure'>July 31, 2026</p><p class='h6'>One</p><p class='paragraph-body'>First.</p></a></div><div role='listitem'><a href='/p/2'><p class='caption-disclosure'>July 30, 2026</p><p class='h6'>Two</p></a></div></main>"
    p = payloads.press_releases(one(spark, press), "https://x.org").collect()
    assert [(x["day"], x["title"], x["summary"], x["url"]) for x in p] == [(dt.date(2026, 7, 31), "One", "First.", "https://x.org/p/1")]


def test_json_payloads(spark):
    row = [1785495600000, "1", "2", "0.5", "1.5", "10", 1785495659999, "15", 7, "4", "6", "0"]
    late = [1785495660000, "1", "2", "0.5", "1.5", "10", 1785495719999, "15", 7, "4", "6", "0"]
    got = payloads.klines(one(spark, json.dumps([row, row, row[:5], late])), F.lit("2026-07-31 11:01:00").cast("timestamp")).collect()
    assert len(got) == 1 and got[0]["trades"] == 7 and float(got[0]["close"]) == 1.5
    chart = [{"date": 1785715200, "totalCirculating": {"peggedUSD": 100}, "totalCirculatingUSD": {"peggedUSD": 101}}, {"date": 1785801600, "totalCirculating": {"peggedUSD": 110}, "totalCirculatingUSD": {"peggedUSD": 111}}]
    assert [r["rejected"] for r in payloads.supply_chart(one(spark, json.dumps(chart))).collect()] == [False, False]
    assert {r["rejected"] for r in payloads.supply_chart(one(spark, json.dumps(chart[::-1]))).collect()} == {True}
    news = {"code": "000000", "data": {"catalogs": [{"catalogId": 48, "catalogName": "New", "total": 2, "articles": [{"id": 101, "code": "one", "title": "T", "type": 1, "releaseDate": 1785495600000}]}]}}
    assert payloads.announcements(one(spark, json.dumps(news))).first()["item_id"] == "101"
    funding = [{"symbol": "E", "fundingTime": 1785495600000, "fundingRate": "0.0001", "markPrice": "", "rateType": "x" * 50}]
    f = payloads.funding(one(spark, json.dumps(funding))).first()
    assert f["mark_price"] is None and len(f["kind"]) == 40
    assert payloads.open_interest(one(spark, json.dumps([{"symbol": "E", "sumOpenInterest": "5", "sumOpenInterestValue": "6", "timestamp": 1785495600000}]))).count() == 1
    assert payloads.volatility_index(one(spark, json.dumps({"result": {"data": [[1785495600000, 1, 2, 3, 4]]}}))).first()["high"] == 2
    options = {"result": [{"instrument_id": 1, "instrument_name": "O", "strike": 5.0, "contract_size": 1.0, "expiration_timestamp": 1785495600000}, {"instrument_id": 2, "strike": 0.0, "contract_size": 1.0}]}
    assert [r["instrument_id"] for r in payloads.option_instruments(one(spark, json.dumps(options))).collect()] == [1]
    assert payloads.option_summaries(one(spark, json.dumps({"result": [{"instrument_name": "O", "open_interest": 1.0}, {"instrument_name": "P", "open_interest": -1.0}]}))).count() == 1


def test_messages(spark):
    kline = {"e": "kline", "E": 1785495600000, "s": "E", "k": {"t": 1785495600000, "o": "1", "h": "2", "l": "1", "c": "2", "q": "1000000", "Q": "650000", "x": True}}
    depth = {"stream": "d", "data": {"e": "depthUpdate", "E": 1785495600000, "s": "E", "b": [["1", "2"]], "a": []}}
    df = spark.createDataFrame([(json.dumps(m),) for m in (kline, depth, {**kline, "s": "X"}, {"e": "other", "s": "E"})] + [("{bad",)], "payload string")
    candles, books, rejected = payloads.messages(df, "E")
    k = candles.first()
    assert (k["taker_sell"], k["delta"], k["closed"]) == (350_000, 300_000, True)
    assert books.count() == 1 and rejected.count() == 3


def test_paged_source(spark, tmp_path):
    host = tmp_path / "pages" / "host"
    host.mkdir(parents=True)
    (host / "first.json").write_text(json.dumps({"rows": [{"at": 1, "payload": {"a": 1}}, {"at": 5, "payload": {}}], "next": "second"}))
    (host / "second.json").write_text(json.dumps({"rows": [{"at": 9, "payload": {}}, {"at": 10, "payload": {}}], "next": None}))
    spark.dataSource.register(paged.PagedSource)
    read = lambda: spark.read.format("pages").option("path", str(tmp_path / "pages")).option("start", 1).option("stop", 10).load()
    assert sorted(r["at"] for r in read().collect()) == [1, 5, 9]
    (host / "second.json").write_text(json.dumps({"rows": [{"at": 9, "payload": {}}], "next": "first"}))
    with pytest.raises(Exception, match="does not advance"):
        read().collect()


def test_retry_waits_and_gives_up():
    waits, answers = [], [paged.TransientError(429), paged.TransientError(503), {"ok": 1}]

    def call():
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert paged.retry(call, sleep=waits.append) == {"ok": 1} and waits == [0.5, 1.0]
    answers[:] = [paged.TransientError(404)]
    with pytest.raises(paged.TransientError):
        paged.retry(call, sleep=waits.append)


def item(**more):
    return {"event_title": None, "actors": [], "action": None, "object": [], "event_status": None, "objective_summary": None} | more


def test_anchors_and_rejections(spark):
    a = item(event_title="Bridge exploit drains funds", actors=["Lazarus"], action="exploited the bridge", object=["Ronin"], event_status="occurred")
    cases = [
        (a, item(actors=["lazarus group"]), (True, None)),
        (a, item(actors=["Lazerusx"]), None),
        (item(actors=["lazarus gang"]), item(object=["lazarus gong"]), (True, None)),
        (a, item(event_title="the new market"), None),
        (a, item(action="hack at the bridge"), (False, None)),
        (a, {**a, "event_status": "ruled"}, (True, "stage")),
        ({**a, "event_status": "planned"}, {**a, "event_status": "proposed"}, (True, None)),
        (item(action="hack", objective_summary="case 1234-a"), item(action="hack", objective_summary="case 9999-b"), (False, "identifier")),
        (item(action="lists token", object=["abc"]), item(action="lists token", object=["xyz"]), (False, "object")),
        (item(actors=["Acme"], action="sued Acme"), item(actors=["Acme"], action="hack of Acme"), (True, "kind")),
        (a, dict(a), (True, None)),
    ]
    day = dt.datetime(2026, 1, 1)
    rows = [(2 * n + k, day + dt.timedelta(days=100 * n), *(x[f.split()[0]] for f in E.FIELDS.split(", "))) for n, (left, right, _) in enumerate(cases) for k, x in enumerate((left, right))]
    items = E.described(spark.createDataFrame(rows, "id long, published timestamp, " + E.FIELDS))
    pairs = E.anchored(items)
    shared = {r["left"] // 2: r["shared"] for r in pairs.collect()}
    told = {r["left"] // 2: (r["score"], r["rejected"]) for r in E.judged(pairs, items, 0.0).collect()}
    for n, (_, _, want) in enumerate(cases):
        assert (None if n not in shared else (shared[n], told[n][1])) == want, n
    assert told[len(cases) - 1][0] == pytest.approx(1.0)


def test_alike_equals_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abc ", k=rng.randint(1, 9))).strip() for _ in range(150)} | {"lazarus group", "lazarus", "the lazarus group", "x"}
    words.discard("")
    frame = spark.createDataFrame([(w,) for w in words], "value string")
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    for least, inside in ((0.86, True), (0.82, False)):
        got = {(r["a"], r["b"]) for r in E.alike(frame, least, inside).collect()}
        assert got == {(a, b) for a in words for b in words if a == b or ratio(a, b) >= least or inside and (a in b or b in a)}


def test_candidates_and_groups(spark):
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    rows = [(i, 0, at(d), title, ["Lazarus"], "exploited", ["Ronin"], "occurred", "") for i, d, title in ((1, 0, "Ronin bridge exploit"), (2, 1, "Ronin bridge exploited"), (3, 30, "Ronin bridge exploit"))]
    items = spark.createDataFrame(rows, "id long, block int, published timestamp, " + E.FIELDS)
    assert [(r["left"], r["right"], r["rejected"]) for r in E.candidates(items).collect()] == [(1, 2, None)]
    nodes = spark.createDataFrame([(i, at(i)) for i in (1, 2, 3)], "id long, published timestamp")
    told = lambda rows: spark.createDataFrame(rows, "left long, right long, relation string, confidence double, conflict boolean")
    chain = told([(1, 2, "same_event", 0.9, False), (2, 3, "same_event", 0.9, False), (1, 3, "different_event", 0.9, False)])
    groups = {r["id"]: r["event_id"] for r in E.complete_link(nodes, chain).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    assert {r["id"]: r["event_id"] for r in E.complete_link(nodes, told([(1, 2, "same_event", 0.84, False), (2, 3, "same_event", 0.9, True)])).collect()} == {1: 1, 2: 2, 3: 3}
    rolled = {r["event_id"]: r for r in E.roll_up(E.complete_link(nodes, chain), nodes.withColumn("source", F.lit("s")), chain).collect()}
    assert (rolled[1]["size"], rolled[1]["status"], rolled[3]["status"]) == (2, "provisional", "provisional")


def test_components_that_do_not_settle_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "left long, right long")
    nodes = spark.createDataFrame([(i,) for i in range(41)], "id long")
    assert {r["component"] for r in E.component_of(edges, nodes).collect()} == {0}
    with pytest.raises(RuntimeError, match="did not settle"):
        E.component_of(edges, nodes, rounds=1)


def test_candidate_pairs_equal_brute_force(spark, tmp_path):
    heads = ["Today", "Reports", "Later", "Sources", "Everyone", "Nobody", "Officials", "Hackers"]
    texts = [f"{h} lazarus group {'drained' if i % 2 else 'drains'} the bridge ronin after an exploit{' in march' * (i % 3)}" for i, h in enumerate(heads)]
    texts += ["Plain weather stays mild over hills", "Other gardens bloom early near lakes"]
    rows = [(i * 11 % 90, 0, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    # every pair of the window, joined without keys
    items = E.described(news._facts(spark, str(tmp_path)))
    a, b = items.select(F.col("id").alias("left"), F.col("day").alias("l"), F.col("x").alias("a")), items.select(F.col("id").alias("right"), F.col("day").alias("r"), F.col("x").alias("b"))
    gap = F.datediff("r", "l")
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    want = set()
    best = {}
    for r in a.crossJoin(b).where(gap.between(0, 14) & ((gap > 0) | (F.col("left") < F.col("right")))).collect():
        x, y = r["a"], r["b"]
        common = [f for f in E.WEIGHTS if x[f] and y[f]]
        score = sum(E.WEIGHTS[f] * ratio(x[f], y[f]) for f in common) / sum(E.WEIGHTS[f] for f in common)
        met = any(set(x[f]) & set(y[f]) for f in ("ids", "tokens", "kinds")) or any(v in w or w in v or ratio(v, w) >= 0.86 for v in x["parties"] for w in y["parties"])
        if score >= 0.20 and (met or x["action"] and y["action"] and ratio(x["action"], y["action"]) >= 0.82):
            best.setdefault(r["right"], []).append((-score, r["left"]))
    want = {(left, right) for right, found in best.items() for _, left in sorted(found)[:5]}
    found = {(r["left"], r["right"]) for r in news.candidate_pairs(spark, str(tmp_path)).collect()}
    assert found == want and len(want) > 5


def test_streams_equal_batches(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [("E", at(s), i, float(s % 7), 0.0) for i, s in enumerate(range(0, 400, 13))]
    batch = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, buy double")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = minutes.drain(spark, minutes.stream_bars(stream), "complete", str(tmp_path / "cp"))
    from marketweave.operators.bars import bars

    want = bars(batch, "1 minute")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_drops_late_samples(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([("E", at(s), float(k)) for k, s in enumerate((1, 3, 3, 2, 4))], "symbol string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    got = minutes.drain(spark, minutes.drop_late(stream), "append", str(tmp_path / "cp"))
    assert sorted(r["value"] for r in got.collect()) == [0.0, 1.0, 4.0]


def test_decisions_are_found_once(spark, monkeypatch):
    runs = spark.sparkContext.accumulator(0)
    judge = E._best

    def counted(most, least):
        run = judge(most, least)

        def counting(batches):
            runs.add(1)
            yield from run(batches)

        return counting

    monkeypatch.setattr(E, "_best", counted)
    news.candidate_pairs(spark, "/root/testdata/sf0.001").collect()
    alone = runs.value
    news.event_rollup(spark, "/root/testdata/sf0.001").collect()
    assert runs.value == 2 * alone > 0


@pytest.mark.parametrize("parse", [payloads.flow_table, payloads.accounts_table, payloads.feed, payloads.incidents, payloads.press_releases])
def test_markup_is_parsed_by_many_tasks(spark, parse):
    pages = spark.range(100).coalesce(1).selectExpr("id AS page", "'<p>' || id AS payload")
    assert parse(pages).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
