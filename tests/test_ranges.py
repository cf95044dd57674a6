"""Pages by time, texts of unknown JSON, and ranks by counts of ranges."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from marketweave.functions import timegrid, variants
from marketweave.operators import ranks
from marketweave.operators.ranks import nearest_ranks
from marketweave.sources import committed, ranged
from marketweave.streaming import upserts


@pytest.fixture()
def pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [(h, at, f"{h}{at}") for h in "ab" for at in range(0, 100, 3)]
    ranged.write_pages(spark.createDataFrame(rows, "host string, at long, payload string"), path, 10)
    spark.dataSource.register(ranged.RangedSource)
    return path


def close(path, keep):
    """Makes every page unreadable but those for which keep(host, from) holds."""
    for folder, _, names in os.walk(path):
        for name in names:
            host, page = (x.split("=")[1] for x in folder.split(os.sep)[-2:]) if "page=" in folder else ("", "0-0")
            if "page=" in folder and name.endswith(".txt") and not keep(host, int(page.split("-")[0])):
                with open(os.path.join(folder, name), "w") as file:
                    file.write("{broken")
                os.path.exists(f"{folder}/.{name}.crc") and os.remove(f"{folder}/.{name}.crc")


def test_only_pages_of_the_range_are_opened(spark, pages):
    close(pages, lambda host, first: host == "a" and 20 <= first <= 50)
    read = lambda: spark.read.format("ranged").option("path", pages).load()
    spark.conf.set(ranged.PUSHDOWN, "true")
    try:
        got = read().where("host = 'a' AND at > 20 AND at <= 57 AND payload <> 'a30'").collect()
        assert sorted(r["at"] for r in got) == [at for at in range(0, 100, 3) if 20 < at <= 57 and at != 30]
        assert read().where("host IN ('a') AND at = 27").count() == 1 and read().where("host = 'a' AND at > 30 AND at < 25").count() == 0
        with pytest.raises(Exception, match="(?s)."):
            read().where("at < 20").collect()
    finally:
        spark.conf.set(ranged.PUSHDOWN, "false")
    known = ranged.Pages(pages)
    assert len(known.known) == 20 and sum(len(s.pages) for s in known.spans(21, 58)) == 8
    assert ranged.Pages(f"{pages}-none").spans(0, 9) == []


def test_filters_that_stay(pages):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    reader = ranged.RangedReader({"path": pages})
    other = EqualTo(("payload",), "x")
    assert list(reader.pushFilters([GreaterThan(("at",), 4), other, LessThan(("at",), 9), EqualTo(("host",), "a")])) == [other]
    assert (reader.low, reader.high, reader.hosts) == (5, 9, {"a"})


def test_stream_reads_on_with_overlap(spark, pages, tmp_path):
    path, keys = str(tmp_path / "t"), ["host", "at"]

    def run():
        stream = spark.readStream.format("ranged").options(path=pages, overlap=10, start=30).load()
        upserts.upsert_stream(stream, path, keys, ["payload"], "at", "s", str(tmp_path / "cp")).awaitTermination()
        return sorted((r["host"], r["at"]) for r in committed.read(spark, path).collect())

    first = run()
    assert first == sorted((h, at) for h in "ab" for at in range(30, 100, 3))
    # a later page, and a row that came late into the last one
    more = spark.createDataFrame([("a", 101, "new"), ("b", 95, "late"), ("b", 41, "too late")], "host string, at long, payload string")
    ranged.write_pages(more, pages, 10)
    close(pages, lambda host, first: first >= 80)  # the overlap reaches back to 90
    assert run() == sorted([*first, ("a", 101), ("b", 95)])


def plain_texts(value, depth=6):
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if depth and isinstance(value, list):
        return [t for x in value for t in plain_texts(x, depth - 1)]
    if depth and isinstance(value, dict) and set(value) <= {"text", "attributes"}:
        return plain_texts(value.get("text"), depth - 1)
    return []


def test_texts_of_any_json(spark):
    rng = random.Random(3)

    def some(depth):
        kind = rng.randrange(9 if depth else 4)
        if kind < 4:
            return rng.choice(["a", " b ", "", "é漢", " \n", 5, 1.5, None, True])
        if kind < 7:
            return [some(depth - 1) for _ in range(rng.randrange(4))]
        return {k: some(depth - 1) for k in rng.sample(["text", "attributes", "other"], rng.randrange(3))}

    values = [some(5) for _ in range(150)] + [[[[[[["deep"]]]]]], [[[[[[["deeper"]]]]]]], {}, [], "x", {"text": None}, {"text": {"text": ["y"]}}]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(-1, None), (-2, "{bad"), (-3, "")]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i long, j string").select("i", variants.texts(F.col("j")).alias("t")).collect()}
    assert got == {**{i: plain_texts(v) for i, v in enumerate(values)}, -1: [], -2: [], -3: []}


@pytest.mark.parametrize(("ranked", "edges"), [(100_000, 64), (5, 8)])
def test_nearest_ranks_equal_sorting(spark, ranked, edges):
    rng = random.Random(5)
    groups = {
        "even": [float(i) for i in range(200)],
        "tails": [rng.choice([-1, 1]) * math.exp(rng.uniform(-600, 600)) for _ in range(150)],
        "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, *[rng.gauss(0, 1) for _ in range(60)]],
        "same": [3.5] * 50,
        "ties": [float(rng.randrange(3)) for _ in range(90)],
        "mostly": [0.0] * 190 + [1e-9 * k for k in range(1, 11)],
        "one": [7.0],
    }
    shares = [0.01, 0.1, 0.5, 0.9, 0.95, 1.0]
    rows = [(g, v) for g, values in groups.items() for v in values] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["share"]): r["value"] for r in nearest_ranks(df, ["g"], "v", shares, ranked, edges).collect()}
    assert got == {(g, s): sorted(values)[max(1, math.ceil(s * len(values))) - 1] for g, values in groups.items() for s in shares}


def test_milliseconds_of_microseconds_round_half_away_from_zero(spark):
    values = [0, 499, 500, 1_499, 1_500, -499, -500, -1_500, 1_704_888_651_859_500, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in df.select(timegrid.rounded_millis(F.col("v"))).collect()] == [0, 0, 1, 1, 2, 0, -1, -2, 1_704_888_651_860, None]


def test_pages_begin_below_their_rows(spark, tmp_path):
    width, path = 86_400_000_000, str(tmp_path / "pages")
    times = [-1, 0, width - 1, width, 20_000 * width - 1, 20_000 * width]
    ranged.write_pages(spark.createDataFrame([("a", t, str(t)) for t in times], "host string, at long, payload string"), path, width)
    assert [low // width for _, low, _, _ in ranged.Pages(path).known] == [-1, 0, 1, 19_999, 20_000]


@pytest.mark.parametrize("sent", [0, ranks.SENT])
def test_few_intervals_go_to_the_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(ranks, "SENT", sent)
    told = []
    monkeypatch.setattr(ranks.F, "broadcast", lambda df: told.append(df) or df.hint("broadcast"))
    values = {g: sorted(float((7 * i) % 1_009) for i in range(n)) for g, n in (("a", 3_000), ("b", 1))}
    df = spark.createDataFrame([(g, v) for g, own in values.items() for v in own], "g string, v double")
    got = {(r["g"], r["share"]): r["value"] for r in nearest_ranks(df, ["g"], "v", [0.001, 0.5, 1.0], ranked=50, edges=8).collect()}
    assert got == {(g, s): own[max(1, math.ceil(s * len(own))) - 1] for g, own in values.items() for s in (0.001, 0.5, 1.0)}
    assert bool(told) == (sent > 0)
