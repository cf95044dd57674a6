"""Groups of events against the loop that defines them, and the way from one run to the next."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.functions.similarity import Both, ratios
from marketweave.operators import events as E
from marketweave.plans import news

TOLD = "left long, right long, relation string, confidence double, conflict boolean"


def plain(items, links):
    """event_id by id: items in order of (published, id) join the first group to whose members they are all linked."""
    partners = defaultdict(set)
    for a, b in links:
        partners[a].add(b)
        partners[b].add(a)
    groups, home = [], {}
    for _, item in sorted((at, i) for i, at in items):
        for n in sorted({home[p] for p in partners[item] if p in home}):
            if partners[item].issuperset(groups[n]):
                break
        else:
            n = len(groups)
            groups.append([])
        groups[n].append(item)
        home[item] = n
    return {i: groups[n][0] for i, n in home.items()}


def frames(spark, items, links):
    start = dt.datetime(2026, 1, 1)
    nodes = spark.createDataFrame([(i, start + dt.timedelta(seconds=at)) for i, at in items], "id long, published timestamp")
    return nodes, spark.createDataFrame([(a, b, "same_event", 0.9, False) for a, b in links], TOLD)


def groups(df):
    rows = df.collect()
    out = {r["id"]: r["event_id"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("seed", "near", "chunk"), [(1, 4, 20_000), (2, 6, 7), (3, 3, 1), (4, 12, 10), (5, 40, 9)])
def test_complete_link_equals_the_loop(spark, seed, near, chunk):
    rng = random.Random(seed)
    items = [(i, rng.randrange(60)) for i in range(70)]  # ties in time
    links = {(a, b) for a in range(60) for b in rng.sample(range(60), 4) if a != b and abs(a - b) <= near}
    nodes, told = frames(spark, items, sorted(links))
    assert groups(E.complete_link(nodes, told, chunk=chunk)) == plain(items, links)


def test_complete_link_of_a_chain_and_a_hub(spark):
    # one component over all chunks: a chain with cliques, and a hub that all are linked to
    n = 3_000
    items = [(i, i) for i in range(n)]
    links = {(i, i + 1) for i in range(n - 1)} | {(i, i + 2) for i in range(0, n - 2, 3)} | {(0, i) for i in range(1, n, 2)}
    nodes, told = frames(spark, items, sorted(links))
    assert groups(E.complete_link(nodes, told, chunk=700)) == plain(items, links)


def test_complete_link_of_a_large_component(spark):
    rng = random.Random(8)
    n = 100_000
    items = [(i, i // 3) for i in range(n)]
    links = {(i, j) for i in range(n) for j in {i - 1, i - rng.randint(1, 5)} if j >= 0 and (j == i - 1) == (rng.random() < 0.7)} | {(i, i + 1) for i in range(0, n - 1, 2)}
    at = dt.datetime(2026, 1, 1)
    ids = spark.range(n).select("id", (F.lit(at).cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, id div 3)")).alias("published"))
    told = spark.createDataFrame([(a, b) for a, b in sorted(links)], "left long, right long").select("left", "right", F.lit("same_event").alias("relation"), F.lit(0.9).alias("confidence"), F.lit(False).alias("conflict"))
    assert groups(E.complete_link(ids, told, chunk=40_000)) == plain(items, links)


def test_retry_split(spark):
    pairs = spark.createDataFrame([(1, 2), (4, 3), (5, 6), (7, 8), (9, 10)], "left long, right long")
    prior = spark.createDataFrame([(11, 2, 1, "same_event", True), (12, 3, 4, "processing_failed", True), (13, 5, 6, "processing_failed", False), (14, 7, 8, "processing_failed", True)], "decision_id long, left long, right long, relation string, is_retryable boolean")
    told = lambda **k: {(r["left"], r["right"]): r["source"] for r in E.retry_split(pairs, prior, **k).collect()}
    assert told() == {(1, 2): "clone", (3, 4): "retry", (5, 6): "clone", (7, 8): "retry", (9, 10): "new"}
    assert told(one=14) == {(1, 2): "clone", (3, 4): "clone", (5, 6): "clone", (7, 8): "retry", (9, 10): "new"}


@pytest.mark.parametrize("seed", [1, 2])
def test_regroup_equals_a_full_run(spark, seed):
    rng = random.Random(seed)
    items = [(i, rng.randrange(40)) for i in range(60)]
    links = {(a, a + k) for a in range(55) for k in (1, 2) if rng.random() < 0.5}
    nodes, before = frames(spark, items, sorted(links))
    changed = (links - set(rng.sample(sorted(links), 3))) | {(2, 50)}
    _, now = frames(spark, items, sorted(changed))
    old = E.complete_link(nodes.where("id <> 59"), before)
    assert groups(E.regroup(old, nodes, before, now)) == plain(items, changed)
    assert groups(E.regroup(old, nodes, before, before)) == plain(items, links)


def test_regroup_query_equals_a_full_run(spark):
    data = "/root/testdata/sf0.001"
    items = news._facts(spark, data).select("id", "published")
    got = groups(news.event_regroup(spark, data))
    told = news._decided(spark, data).where("score >= 0.6 and right % 50 <> 0").select("left", "right")
    want = plain([(r["id"], r["published"]) for r in items.collect()], {(r["left"], r["right"]) for r in told.collect()})
    assert got == want


def test_roll_up_equals_a_loop(spark):
    data = "/root/testdata/sf0.001"
    items = {r["id"]: r for r in news._facts(spark, data).select("id", "published", "source").collect()}
    told = news._decided(spark, data).collect()
    event = groups(news.event_groups(spark, data))
    want = {}
    for e in set(event.values()):
        own = [items[i] for i, g in event.items() if g == e]
        about = [d for d in told if event[d["left"]] == e or event[d["right"]] == e]
        conflicted, unsure = any(d["conflict"] for d in about), any(d["relation"] in ("uncertain", "processing_failed") for d in about)
        status = "conflicted" if conflicted else "uncertain" if len(own) == 1 and unsure else "provisional"
        confidence = round(min(d["confidence"] for d in about), 6) if about else None
        want[e] = (len(own), min(r["published"] for r in own), max(r["published"] for r in own), len({r["source"] for r in own}), confidence, status)
    got = {r["event_id"]: (r["size"], r["first"], r["last"], r["sources"], r["confidence"], r["status"]) for r in news.event_rollup(spark, data).collect()}
    assert got == want


@pytest.mark.parametrize(("block", "batch"), [(4_096, 10_000), (7, 13)])
def test_candidates_compare_few_of_many_pairs(spark, monkeypatch, block, batch):
    # one common word in all titles, so that all pairs are asked for; copies, and titles of over 200 letters
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(120)]
    some = lambda k: " ".join(rng.choices(words, k=k))
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(days=rng.randrange(20)), "bridge " + some(rng.choice([1, 4, 9, 50])), [some(1), some(1)], some(3), [some(1)] if i % 9 else None, "occurred" if i % 5 else "", "") for i in range(100)]
    rows += [(300 + i, dt.datetime(2026, 1, 9), *rows[3][2:]) for i in range(40)] + [(400, None, *rows[3][2:])]
    monkeypatch.setattr(E, "BLOCK", block)
    items = E.described(spark.createDataFrame(rows, "id long, published timestamp, " + E.FIELDS))
    dealt = E._dealt(items, 14).toArrow().sort_by([(c, "ascending") for c in ("block", "part", "side", "id")])
    compared, compare = [0], Both.ratios

    def counted(self, i, j, least=0.0):
        compared[0] += len(i)
        return compare(self, i, j, least)

    monkeypatch.setattr(Both, "ratios", counted)
    got = {(r["left"], r["right"]): (r["score"], r["shared"], r["near"]) for b in E._best(5, 0.2)(iter(dealt.combine_chunks().to_batches(batch))) for r in b.to_pylist()}
    monkeypatch.undo()
    known = [r for r in items.collect() if r["day"]]
    pairs = [(a, b) for a in known for b in known if 0 <= (b["day"] - a["day"]).days <= 14 and (a["day"] < b["day"] or a["id"] < b["id"])]
    found = {f: ratios([a["x"][f] for a, _ in pairs], [b["x"][f] for _, b in pairs]) for f in E.WEIGHTS}
    score = sum(w * np.nan_to_num(found[f]) for f, w in E.WEIGHTS.items()) / sum(w * ~np.isnan(found[f]) for f, w in E.WEIGHTS.items())
    best = defaultdict(list)
    for n in np.flatnonzero(score >= 0.2).tolist():
        best[pairs[n][1]["id"]].append((-round(score[n], 9), pairs[n][0]["id"], found["action"][n]))
    want = {(left, right): (-score, near) for right, some in best.items() for score, left, near in sorted(some)[:5]}
    assert {k: (round(score, 9), near) for k, (score, _, near) in got.items()} == want
    assert all(shared for _, shared, _ in got.values())
    assert compared[0] < len(pairs) * len(E.WEIGHTS) / 2


@pytest.mark.parametrize("query", ["event_groups", "event_regroup", "event_rollup"])
def test_events_join_no_pairs(spark, monkeypatch, query):
    def refused(*_):
        raise AssertionError("pairs with an anchor are rows")

    monkeypatch.setattr(E, "anchored", refused)
    assert news.QUERIES[query](spark, "/root/testdata/sf0.001").count() == 20
