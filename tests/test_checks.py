"""Checks of answers and facts, runs and schedules."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marketweave.operators import decisions
from marketweave.operators import news as N
from marketweave.operators import runs as R
from marketweave.operators import validation as V
from marketweave.plans import checks


@pytest.mark.parametrize(
    ("value", "quote", "want"),
    [
        ("2024-Q3", "in Q3 of 2024 it", True),
        ("2024-Q3", "in Q2 2024", False),
        ("2024-05", "during May  2024", True),
        ("2024-05-09", "on May 9, 2024", True),
        ("2024-05-09", "9 may 2024", True),
        ("2024-05-09", "2024年5月9日", True),
        ("2024-05-09T10:30", "May 9, 2024 at 10:30", True),
        ("2024-05-09T10:30", "May 9, 2024 at 11:30", False),
        ("2024-05-09/2024-06", "from May 9, 2024 to June 2024", True),
        ("2024", "nothing", False),
    ],
)
def test_time_in_evidence(spark, value, quote, want):
    df = spark.createDataFrame([(value, quote)], "v string, q string")
    assert df.select(V.time_supported(F.col("v"), F.col("q")).alias("x")).first()["x"] is want


def test_first_facts_keep_order(spark):
    df = spark.createDataFrame([([("A b",), ("a  B",), (None,), ("c",), ("",), ("A B ",)],)], "facts array<struct<statement: string>>")
    assert [f["statement"] for f in df.select(V.first_facts(F.col("facts")).alias("x")).first()["x"]] == ["A b", None, "c", ""]


def test_first_facts_of_long_lists(spark):
    rng = random.Random(5)
    lists = [[rng.choice([None, "", " ", f" A  {rng.randrange(9_000)} b", f"a {rng.randrange(9_000)} B"]) for _ in range(12_000)] for _ in range(4)]
    df = spark.createDataFrame([(n, [(x,) for x in own]) for n, own in enumerate([*lists, []])] + [(5, None)], "n int, facts array<struct<statement: string>>")
    begun = time.monotonic()
    got = {r["n"]: r["x"] and [f["statement"] for f in r["x"]] for r in df.select("n", V.first_facts(F.col("facts")).alias("x")).collect()}
    assert time.monotonic() - begun < 30  # each key was made anew for each fact
    for n, own in enumerate(lists):
        seen, want = set(), []
        for x in own:
            key = " ".join((x or "").split()).lower()
            if not key or key not in seen:
                want.append(x)
            seen.add(key)
        assert got[n] == want
    assert got[4] == [] and got[5] is None


def test_answers(spark):
    item = "array<struct<news_id: bigint, conclusion: string, rationale: string, content_summary: string>>"
    rows = [([(1, "bullish", "r", "")], [1]), ([(1, "up", " ", None), (1, "bullish", "r" * 501, "s")], [1, 2]), (None, [1]), ([(3, "bullish", "r", "s")], [])]
    df = spark.createDataFrame(rows, f"items {item}, asked array<bigint>")
    got = [r["e"] for r in df.select(V.direction_errors(F.col("items"), F.col("asked"), ["bullish"]).alias("e")).collect()]
    assert got == [[], ["bad_conclusion", "no_rationale", "long_rationale", "no_summary", "repeated_id", "absent_id"], ["no_items"], ["foreign_id"]]


def test_filters_and_pairs(spark):
    rows = [(("direct", "PASS", "why", True),), (("direct", "NO", "why", True),), (("irrelevant", "PASS", "", True),), (("direct", "WIDE", "why", True),), (("irrelevant", "NO", "why", False),)]
    df = spark.createDataFrame(rows, "i struct<research_relevance: string, filter_reason_code: string, filter_reason: string, should_extract_event: boolean>")
    codes = V.filter_errors(F.col("i"), ["direct", "broad", "irrelevant"], ["PASS", "WIDE", "NO"], {"direct": "PASS", "broad": "WIDE"})
    assert [r["e"] for r in df.select(codes.alias("e")).collect()] == [[], ["code_contradicts", "wrong_pass_code"], ["bad_reason", "passes_irrelevant"], ["wrong_pass_code"], []]
    pairs = spark.createDataFrame([(("same", 0.5, "r", False, "T"),), (("odd", 2.0, None, None, "X"),)], "a struct<relation: string, confidence: double, reason: string, has_fact_conflict: boolean, canonical_title: string>")
    got = [r["e"] for r in pairs.select(V.pair_errors(F.col("a"), F.array(F.lit("T")), ["same"]).alias("e")).collect()]
    assert got == [[], ["bad_relation", "bad_confidence", "no_reason", "no_conflict_flag", "foreign_title"]]


def test_fact_issues(spark):
    facts = [("s", "reported", "said May 1, 2024", "2024-05-01"), ("", "odd", "absent", "2024-05"), ("t", "reported", "said  May", "2024-99")]
    schema = "id long, event_time string, facts array<struct<statement: string, claim_type: string, evidence_text: string, fact_time: string>>, title string, summary string, body string"
    rows = [(1, "2024-05-01", facts, "it said May 1, 2024", "", "he said May"), (2, "2024-05-02", facts[:1], "it said May 1, 2024", "", "")]
    got = sorted((r["id"], r["path"], r["code"]) for r in V.fact_issues(spark.createDataFrame(rows, schema), ["reported"]).collect())
    assert got == [
        (1, "facts[1]", "EVIDENCE_NOT_MATCHED"),
        (1, "facts[1]", "FACT_TIME_NOT_IN_EVIDENCE"),
        (1, "facts[1]", "INVALID_CLAIM_TYPE"),
        (1, "facts[1]", "INVALID_STATEMENT"),
        (1, "facts[2]", "INVALID_FACT_TIME"),
        (2, "event_time", "EVENT_TIME_NOT_BACKED_BY_FACT"),
    ]


def test_rows_of_facts_carry_no_texts(spark):
    schema = "id long, event_time string, facts array<struct<statement: string, claim_type: string, evidence_text: string, fact_time: string>>, title string, summary string, body string"
    found = V.fact_issues(spark.createDataFrame([], schema), ["reported"])
    by_fact = found._jdf.queryExecution().optimizedPlan().toString().split("posexplode")[0]
    assert "EVIDENCE_NOT_MATCHED" in by_fact and "body" not in by_fact


def test_schedules(spark):
    at = lambda text: F.lit(text).cast("timestamp")
    r = spark.range(1).select(
        R.next_daily(at("2026-01-01 00:00:00"), F.lit(9 * 3600)).cast("timestamp_ntz").alias("today"),
        R.next_daily(at("2026-01-01 01:00:00"), F.lit(9 * 3600)).cast("timestamp_ntz").alias("tomorrow"),
        R.next_interval(at("2026-01-01 03:30:00"), F.lit(9 * 3600), F.lit(4)).cast("timestamp_ntz").alias("grid"),
        R.utc_range(at("2026-01-05 13:00:00"), 3)[0].cast("timestamp_ntz").alias("start"),
        R.answer_class(F.lit(429)).alias("a"),
        R.answer_class(F.lit(404)).alias("b"),
    ).first()
    assert (r["today"], r["tomorrow"], r["grid"]) == (dt.datetime(2026, 1, 1, 1), dt.datetime(2026, 1, 2, 1), dt.datetime(2026, 1, 1, 5))
    assert (r["start"], r["a"], r["b"]) == (dt.datetime(2026, 1, 2), "retry", "fatal")
    with pytest.raises(ValueError, match="days"):
        R.utc_range(F.lit(0), 31)


def test_fingerprints_ignore_order_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    own = R.fingerprint(df).first()
    assert R.fingerprint(df.orderBy(F.desc("x")).select("y", "x")).first() == own
    assert R.fingerprint(df.distinct()).first() != own and R.fingerprint(df.limit(0)).first()["rows"] == 0


def test_watermarks(spark):
    rows = [("passed", True), ("warning", True), ("passed", False), ("failed", True)]
    df = spark.createDataFrame(rows, "q string, c boolean")
    assert [r["w"] for r in df.select(R.advance(F.lit(1), F.col("q"), F.col("c"), F.lit(5)).alias("w")).collect()] == [5, 5, 1, 1]


def test_fact_issues_equal_a_loop(spark):
    """The query over all documents against plain Python: statements, claim types, evidence and times."""
    data = "/root/testdata/sf0.001"
    space = "[ \\t\\n\\x0b\\f\\r]+"
    tidy = lambda x: re.sub(space, " ", x).strip(" ")
    day = re.compile(r"2024-05-01|\bMay\s+1,\s*2024\b|\b1\s+May\s+2024\b|2024年\s*5月\s*1日", re.IGNORECASE)
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect():
        text, told = r["text"], False
        for i, s in enumerate(text.split(".")):
            quote = f"{s} never said" if i % 3 == 2 else s
            found = tidy(quote) != "" and (quote in text or tidy(quote) in tidy(text))
            named = bool(day.search(tidy(quote)))
            told |= i == 0 and named
            codes = {"INVALID_STATEMENT": tidy(s) == "", "INVALID_CLAIM_TYPE": i % 5 == 4, "EVIDENCE_NOT_MATCHED": not found, "FACT_TIME_NOT_IN_EVIDENCE": i == 0 and not named}
            want += [(r["doc_id"], f"facts[{i}]", c) for c, holds in codes.items() if holds]
        if not told:
            want.append((r["doc_id"], "event_time", "EVENT_TIME_NOT_BACKED_BY_FACT"))
    got = sorted((r["id"], r["path"], r["code"]) for r in checks.fact_issues(spark, data).collect())
    assert got == sorted(want) and len({c for _, _, c in got}) == 5


def test_dedup_takes_the_first_of_hot_bodies(spark):
    rows = [(i, "s" if i % 2 else "t", None if i % 10 == 9 else "" if i % 3 else f"b{i % 7}", f"h{i}") for i in range(200)]
    got = {r["i"] for r in N.dedup(spark.createDataFrame(rows, "i long, source string, body string, head string"), "source", ["body", "head"], "i").collect()}
    seen, want = set(), set()
    for i, source, body, _ in rows:
        if body is None or (source, body) not in seen:
            seen.add((source, body))
            want.add(i)
    assert got == want


def plain_cascade(records, answers, size, limit):
    """The stages by a loop over each run: (run, id, stage, status, conclusion)."""
    out = []
    for run in {r[0] for r in records}:
        own = sorted(r[1:] for r in records if r[0] == run)
        out += [(run, i, "title_rule", "success", rule) for i, rule, _ in own if rule is not None]
        used, stopped, left, details = 0, False, [(i, only) for i, rule, only in own if rule is None], []
        for stage in decisions.STAGES:
            mine = [x for x in left if stage == "title_ai" or x[1] == (stage == "summary_ai")]
            unclear = []
            for k in range(0, len(mine), size):
                batch = [(i, only, *answers.get((run, i, stage), ("unclear", 1, False))) for i, only in mine[k : k + size]]
                served = used < limit and not stopped
                if served:
                    used, stopped = used + max(x[3] for x in batch), any(x[4] for x in batch)
                status = ("failed" if stopped else "success") if served else "skipped"
                for i, only, told, _, _ in batch:
                    if stage == "title_ai" and status == "success" and told == "unclear":
                        unclear.append((i, only))
                    else:
                        (out if stage == "title_ai" else details).append((run, i, stage, status, told if status == "success" else None))
            left = unclear if stage == "title_ai" else left
        out += [x for x in details if not (stopped and x[3] == "skipped")]
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1])
def test_cascade_numbers_the_first_records_only(spark, monkeypatch, least):
    """Also where answers that take no request let a run go on beyond the records looked at first."""
    monkeypatch.setattr(decisions, "FIRST", 6)
    rng = random.Random(7)
    records = [(run, 3 * i, "bullish" if rng.random() < 0.1 else None, rng.random() < 0.5) for run in range(12) for i in range(8 * run + 1)]
    answers = {(run, i, stage): (rng.choice(["unclear", "bullish"]), rng.randint(least, 2), rng.random() < 0.01) for run, i, _, _ in records for stage in decisions.STAGES if rng.random() < 0.9}
    if not least:
        answers |= {(9, i, stage): ("bullish", 0, False) for run, i, _, _ in records if run == 9 for stage in decisions.STAGES}
    r = spark.createDataFrame(records, "run long, id long, rule string, summary_only boolean")
    a = spark.createDataFrame([(*k, *v) for k, v in answers.items()], "run long, id long, stage string, conclusion string, requests int, fatal boolean")
    found = decisions.cascade(r, a, 3, 12)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, found.select("run", "id", "stage", "status", "conclusion").collect()), key=str)
    assert got == plain_cascade(records, answers, 3, 12) and {x[3] for x in got} == {"success", "failed", "skipped"}
