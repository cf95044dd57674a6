"""Checks of model answers and extracted facts, as arrays of error codes; evidence spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.text import evidences, tidy
from marketweave.operators.quality import broken

# Names of months in evidence.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _blank(c: Column) -> Column:
    return F.coalesce(tidy(c), F.lit("")) == ""


def time_literal(value: Column) -> Column:
    """Whether a text is a year, quarter, month, ISO date or time, or two of them parted by a slash."""
    day = lambda p: p.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T.+)?$") & F.try_to_timestamp(p).isNotNull()
    atom = lambda p: p.rlike(r"^[0-9]{4}$") | p.rlike(r"^[0-9]{4}-Q[1-4]$") | p.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$") | day(p)
    parts = F.split(value, "/")
    return F.coalesce((F.size(parts) <= 2) & F.forall(parts, atom), F.lit(False))


def time_supported(value: Column, quote: Column) -> Column:
    """Whether a quote names a time: literally, or as a quarter, month or day in words."""
    flat = tidy(quote)
    name = lambda month: F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))

    def atom(p: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(p, pattern, i)
        quarter, month, day = r"^([0-9]{4})-Q([1-4])$", r"^([0-9]{4})-(0[1-9]|1[0-2])$", r"^([0-9]{4})-(0[1-9]|1[0-2])-([0-9]{2})(?:T([0-9]{2}:[0-9]{2}).*)?$"
        by_quarter = F.rlike(flat, F.concat(F.lit(r"(?i)\bQ"), part(quarter, 2), F.lit(r"(?:\s+of)?\s+"), part(quarter, 1), F.lit(r"\b")))
        by_month = F.rlike(flat, F.concat(F.lit(r"(?i)\b"), name(part(month, 2)), F.lit(r"\s+"), part(month, 1), F.lit(r"\b")))
        d = part(day, 3).cast("int").cast("string")
        words = F.concat(F.lit(r"(?i)\b(?:"), name(part(day, 2)), F.lit(r"\s+"), d, F.lit(r",\s*"), part(day, 1), F.lit("|"), d, F.lit(r"\s+"), name(part(day, 2)), F.lit(r"\s+"), part(day, 1), F.lit(r")\b|"), part(day, 1), F.lit(r"年\s*"), part(day, 2).cast("int").cast("string"), F.lit(r"月\s*"), d, F.lit("日"))
        by_day = F.rlike(flat, words) & ((part(day, 4) == "") | F.contains(flat, part(day, 4)))
        return F.contains(flat, p) | F.when(p.rlike(quarter), by_quarter).when(p.rlike(month), by_month).when(p.rlike(day), by_day).otherwise(F.lit(False))

    return F.coalesce(F.contains(flat, value) | F.forall(F.split(value, "/"), atom), F.lit(False))


def first_facts(facts: Column) -> Column:
    """Facts (with a statement) without those whose statement came before, but for case and white space."""
    key = lambda f: F.lower(tidy(F.coalesce(f["statement"], F.lit(""))))
    keyed = F.transform(facts, lambda f, i: F.struct(key(f).alias("key"), i.alias("i")))

    def kept(x: Column) -> Column:
        """Facts by number, of which each stands by its predecessor of the same key."""
        first = F.filter(x["keys"], lambda k, n: (k["key"] == "") | (n == 0) | (k["key"] != F.get(x["keys"], F.greatest(n - 1, F.lit(0)))["key"]))
        return F.transform(F.sort_array(F.transform(first, lambda k: k["i"])), lambda i: F.get(x["facts"], i))

    # an array of one element names its content, which is computed once instead of once per fact
    return F.get(F.transform(F.array(F.struct(facts.alias("facts"), F.sort_array(keyed).alias("keys"))), kept), F.lit(0))


def id_errors(returned: Column, requested: Column) -> dict[str, Column]:
    """Answers must name every requested id exactly once."""
    return {
        "repeated_id": F.size(F.array_distinct(returned)) < F.size(returned),
        "foreign_id": F.size(F.array_except(returned, requested)) > 0,
        "absent_id": F.size(F.array_except(requested, returned)) > 0,
    }


def direction_errors(items: Column, requested: Column, conclusions: list[str], longest: int = 500) -> Column:
    """Codes for an answer of items (news_id, conclusion, rationale, content_summary)."""
    some = lambda test: F.coalesce(F.exists(items, test), F.lit(False))
    return broken({
        "no_items": items.isNull(),
        "no_id": some(lambda x: x["news_id"].isNull()),
        "bad_conclusion": some(lambda x: F.coalesce(~x["conclusion"].isin(conclusions), F.lit(True))),
        "no_rationale": some(lambda x: _blank(x["rationale"])),
        "long_rationale": some(lambda x: F.char_length(F.trim(x["rationale"])) > longest),
        "no_summary": some(lambda x: x["content_summary"].isNull()),
        **id_errors(F.transform(items, lambda x: x["news_id"]), requested),
    })


def filter_errors(item: Column, relevance: list[str], codes: list[str], passing: dict[str, str]) -> Column:
    """Codes for one relevance decision; passing names the reason code of each relevance that passes."""
    go, level, code = item["should_extract_event"], item["research_relevance"], item["filter_reason_code"]
    wanted = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in passing.items()])
    return broken({
        "bad_relevance": F.coalesce(~level.isin(relevance), F.lit(True)),
        "bad_code": F.coalesce(~code.isin(codes), F.lit(True)),
        "bad_reason": _blank(item["filter_reason"]) | (F.char_length(F.trim(item["filter_reason"])) > 500),
        "no_decision": go.isNull(),
        "passes_irrelevant": go & ~level.isin(list(passing)),
        "code_contradicts": go != code.isin(list(passing.values())),
        "wrong_pass_code": go & F.coalesce(code != wanted, F.lit(False)),
    })


def pair_errors(answer: Column, titles: Column, relations: list[str]) -> Column:
    """Codes for one pair decision; its title must be one of the members' titles."""
    return broken({
        "bad_relation": F.coalesce(~answer["relation"].isin(relations), F.lit(True)),
        "bad_confidence": ~F.coalesce(answer["confidence"].between(0, 1), F.lit(False)),
        "no_reason": answer["reason"].isNull(),
        "no_conflict_flag": answer["has_fact_conflict"].isNull(),
        "foreign_title": answer["canonical_title"].isNotNull() & ~F.array_contains(titles, F.trim(answer["canonical_title"])),
    })


def fact_issues(results: DataFrame, claim_types: list[str]) -> DataFrame:
    """(id, path, code) of the facts of results (id, event_time, facts, title, summary, body).

    facts: array of (statement, claim_type, evidence_text, fact_time).
    """
    # quotes are found before facts become rows, so that no row carries the texts
    found = results.select("id", "facts", evidences(F.col("facts.evidence_text"), *map(F.col, ("title", "summary", "body"))).alias("found"))
    fact = found.select("id", F.posexplode(F.arrays_zip("facts", "found")).alias("n", "x")).select("id", "n", F.col("x.facts").alias("f"), F.col("x.found").alias("found"))
    quote = F.col("f.evidence_text")
    timed = F.col("f.fact_time").isNotNull()
    codes = broken({
        "INVALID_STATEMENT": _blank(F.col("f.statement")),
        "INVALID_CLAIM_TYPE": F.coalesce(~F.col("f.claim_type").isin(claim_types), F.lit(True)),
        "EVIDENCE_NOT_MATCHED": F.col("found").isNull(),
        "INVALID_FACT_TIME": timed & ~time_literal(F.col("f.fact_time")),
        "FACT_TIME_NOT_IN_EVIDENCE": timed & time_literal(F.col("f.fact_time")) & ~time_supported(F.col("f.fact_time"), quote),
    })
    own = fact.select("id", F.format_string("facts[%d]", "n").alias("path"), F.explode(codes).alias("code"))
    backed = F.exists("facts", lambda f: (f["fact_time"] == F.col("event_time")) & time_supported(f["fact_time"], f["evidence_text"]))
    whole = broken({
        "INVALID_EVENT_TIME": F.col("event_time").isNotNull() & ~time_literal(F.col("event_time")),
        "EVENT_TIME_NOT_BACKED_BY_FACT": F.col("event_time").isNotNull() & ~F.coalesce(backed, F.lit(False)),
    })
    return own.unionByName(results.select("id", F.lit("event_time").alias("path"), F.explode(whole).alias("code")))


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching spans (start, stop) of each key."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start") > reach)).cast("int")
    numbered = spans.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w))
    return numbered.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__island")


def publication_date(text: Column, day: Column) -> Column:
    """explicit where a text names a day, inferred where it says today, else null."""
    iso = F.date_format(day, "yyyy-MM-dd")
    today = text.rlike(r"(?i)\btoday\b|\bthis day\b|今天|今日")
    return F.when(time_supported(iso, text), "explicit").when(today, "inferred")
