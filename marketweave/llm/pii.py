"""Personal data, and terms that give it away, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, payment card numbers and phone numbers. Protected
entities are their values and the groups that values share: an address's domain, the network of an
IP address, a card's issuer, a phone number without its last four digits. Terms are found by
information: a word that stands, outside of base spans, in texts of an entity in at least SUPPORT
groups of near copies, and whose presence tells at least THRESHOLD of the entity's information
content, log(p(entity | term) / p(entity)) / -log p(entity), discloses the entity. Probabilities
are shares of the different texts of the corpus, p(entity | term) with one text more that has the
term alone and half a text less that has both, so that a few chance meetings tell little. Near
copies among the texts that have spans count as one text throughout; a passage that different texts
share counts in each.
Such terms are spans of kind "term" wherever they stand, with the entity or without.

Base patterns are matched leftmost and without overlap per kind. Possessive forms and the look
behind keep matching linear in the text; they accept the same spans as the plain patterns.

Defined cases: a null or empty text has no spans; matches that fail their check are dropped and
not tried again; spans of different kinds may overlap; repeated rows each return a row; an empty
table gives an empty result; further columns are kept by `sanitise` and ignored by `find`.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import components, cut, saved, small, text_of

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
SUPPORT, THRESHOLD = 3, 0.8
#: Near copies: least hashes of runs of three words, in bands of so many; how many must agree in texts of at least LONG runs, and in shorter ones.
HASHES, BAND = 32, 4
LONG, AGREE_LONG, AGREE_SHORT = 64, 20, 26
_WORD = r"[\p{L}\p{N}]+"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _spans(kind: str, pattern: str, check: str) -> str:
    """SQL: array of (start, rank, kind, end) of the matches in text that pass a check on m."""
    quoted = _quoted(pattern)
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)
    return f"""transform(filter(aggregate(
        zip_with(regexp_extract_all(text, {quoted}, 0), slice(split(text, {quoted}, -1), 1, size(split(text, {quoted}, -1)) - 1), (m, gap) -> struct(m AS m, char_length(gap) AS gap)),
        CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, m: STRING>>),
        (out, x) -> concat(out, array(struct(
            coalesce(try_element_at(out, -1).e, 0) + x.gap AS s,
            coalesce(try_element_at(out, -1).e, 0) + x.gap + char_length(x.m) AS e,
            x.m AS m)))), x -> {check.replace("$m", "x.m")}),
        x -> struct(x.s AS start, {rank} AS rank, '{kind}' AS kind, x.e AS end, x.m AS value))"""


_DIGITS = "regexp_replace($m, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": "forall(split($m, '[.]'), p -> char_length(ltrim('0', p)) <= 2 OR (char_length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))",
    "card": f"""char_length({_DIGITS}) BETWEEN 14 AND 19 AND aggregate(sequence(1, char_length({_DIGITS})), 0, (sum, i) -> sum +
        if(i % 2 = 1, CAST(substr(reverse({_DIGITS}), i, 1) AS INT), element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), CAST(substr(reverse({_DIGITS}), i, 1) AS INT) + 1))) % 10 = 0""",
    "phone": f"char_length({_DIGITS}) BETWEEN 10 AND 15",
}
_EMPTY = "CAST(array() AS ARRAY<STRUCT<start: INT, rank: INT, kind: STRING, end: INT, value: STRING>>)"


def base_spans() -> Column:
    """Array of (start, rank, kind, end, value) of the base spans of column text, in order."""
    found = []
    for kind in KINDS:
        hint = f"contains(text, '{HINTS[kind]}')" if kind == "email" else f"text RLIKE {_quoted(HINTS[kind])}"
        found.append(f"CASE WHEN {hint} THEN {_spans(kind, PATTERNS[kind], CHECKS[kind])} ELSE {_EMPTY} END")
    return F.array_sort(F.concat(*[F.expr(x) for x in found]))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def _disclosure(together: str, documents: str) -> Column:
    """Share of an entity's information that a term of so many texts tells."""
    given = (F.col(together) - 0.5) / (F.col(documents) + 1)
    return F.log(given * F.col("n") / F.col("with_entity")) / F.greatest(F.log(F.col("n") / F.col("with_entity")), F.lit(1e-9))


#: What stands for a span of a kind in entities: the value, and the group that it belongs to.
_ENTITIES = f"""array(lower(x.value), CASE x.kind
    WHEN 'email' THEN concat('@', substring_index(lower(x.value), '@', -1))
    WHEN 'ip' THEN concat(substring_index(x.value, '.', 3), '.*')
    WHEN 'card' THEN concat('card:', substr({_DIGITS.replace("$m", "x.value")}, 1, 6))
    ELSE concat('phone:', regexp_extract({_DIGITS.replace("$m", "x.value")}, '^([0-9]*)[0-9]{{4}}$', 1)) END)"""


def _replaced(by: str) -> Column:
    """text with each of its spans replaced by an SQL expression on the span s; overlapping spans by that of the first."""
    return F.expr(f"""
        CASE WHEN size(spans) = 0 THEN text ELSE aggregate(
            spans,
            struct(CAST(array() AS ARRAY<STRING>) AS parts, 0 AS at),
            (acc, s) -> CASE
                WHEN s.end <= acc.at THEN acc
                WHEN s.start < acc.at THEN struct(acc.parts AS parts, s.end AS at)
                ELSE struct(concat(acc.parts, array(substr(text, acc.at + 1, s.start - acc.at), {by})) AS parts, s.end AS at) END,
            acc -> concat(array_join(acc.parts, ''), substr(text, acc.at + 1))) END""")


def near_copies(texts: DataFrame) -> DataFrame:
    """(h, root) of the texts (h, text), h different, that have near copies among them: root is the same within a group.

    Texts that share a band of least hashes are compared with the first of them only, so no pairs are made.
    """
    rng = random.Random(11)
    salts = [rng.getrandbits(32) - (1 << 31) for _ in range(HASHES)]
    words = texts.select("h", F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)).alias("w"))
    runs = words.select("h", F.expr("transform(sequence(0, greatest(size(w) - 3, 0)), i -> hash(get(w, i), get(w, i + 1), get(w, i + 2)))").alias("runs"))
    signs = runs.select("h", F.size("runs").alias("n"), F.array(*[F.expr(f"array_min(transform(runs, x -> x ^ ({c})))") for c in salts]).alias("sign"))
    bands = F.array(*[F.xxhash64(F.lit(i), *[F.col("sign")[i + j] for j in range(BAND)]) for i in range(0, HASHES, BAND)])
    rows = cut(signs).select("h", "n", "sign", F.explode(bands).alias("band"))
    first = rows.groupBy("band").agg(F.min(F.struct("h", "n", "sign")).alias("first"), F.count("*").alias("size")).where("size > 1")
    agree = F.expr("size(filter(zip_with(sign, first.sign, (a, b) -> a = b), x -> x))")
    enough = F.when(F.least("n", "first.n") >= LONG, AGREE_LONG).otherwise(AGREE_SHORT)
    edges = rows.join(first, "band").where((F.col("h") != F.col("first.h")) & (agree >= enough)).select(F.col("h").alias("u"), F.col("first.h").alias("v"))
    return components(edges).select(F.col("node").alias("h"), "root")


def holding(texts: DataFrame, terms: DataFrame, *keep: str) -> DataFrame:
    """(term, keep..) of the texts that hold a term, one row each."""
    return texts.select(*keep, F.explode(_words(F.col("text"))).alias("term")).join(terms, "term")


def disclosing(docs: DataFrame, marked: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(term, entity, disclosure) from docs (text) and marked (text, spans), the texts that have base spans."""
    texts = marked.select(F.xxhash64("text").alias("h"), "text", "spans").dropDuplicates(["h"])
    at = texts.select("h", F.explode("spans").alias("x")).select("h", F.explode(F.expr(_ENTITIES)).alias("entity")).distinct()
    # an entity of fewer texts than the support has no terms
    often = at.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("entity")
    at = cut(at.join(often, "entity"))
    groups = near_copies(texts.join(at.select("h").distinct(), "h", "left_semi").select("h", "text"))
    rooted = cut(texts.select("h").join(groups, "h", "left").select("h", F.coalesce("root", "h").alias("root")))
    words = texts.select("h", F.explode(_words(_replaced("' '"))).alias("term")).where(F.char_length("term") > 1).join(rooted, "h")
    placed = at.join(rooted, "h").select("h", "entity", "root")
    entities = placed.select("entity", "root").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    both = words.drop("root").join(placed, "h").select("entity", "term", "root").distinct().groupBy("entity", "term").agg(F.count("*").alias("together"))
    # a term is in no fewer texts than in those that have spans: where these alone rule it out, the others aren't counted
    met = words.groupBy("term", "root").agg(F.count("*").alias("texts")).groupBy("term").agg(F.count("*").alias("met"), F.sum("texts").alias("met_texts"))
    sums = rooted.agg(F.count("*").alias("texts"), F.count_distinct("root").alias("groups")).first()
    n = docs.select(F.xxhash64("text").alias("h")).distinct().count() - sums.texts + sums.groups
    likely = both.where(F.col("together") >= support).join(entities, "entity").withColumn("n", F.lit(n)).join(met, "term")
    candidates = cut(likely.where(_disclosure("together", "met") >= threshold))
    terms = candidates.select("term").distinct()
    # every text counts; equal texts count once
    known = docs.select(F.xxhash64("text").alias("h"), "text")
    frequency = holding(known, small(terms), "h").distinct().groupBy("term").agg(F.count("*").alias("texts"))
    counted = candidates.join(frequency, "term").withColumn("with_term", F.col("texts") - F.col("met_texts") + F.col("met"))
    scored = counted.withColumn("disclosure", _disclosure("together", "with_term"))
    return scored.where(F.col("disclosure") >= threshold).select("term", "entity", "disclosure")


def marked(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with text (never null), base and spans: arrays of (start, rank, kind, end, value)."""
    whole = docs.withColumn("text", text_of())
    base = whole.withColumn("base", base_spans())
    keyed = saved(base.where(F.size("base") > 0).select("text", F.col("base").alias("spans")))
    terms = cut(disclosing(whole.select("text"), keyed, support, threshold).select("term").distinct())
    if terms.isEmpty():
        return base.withColumn("spans", F.col("base"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), F.col("term"), F.lit(r"(?![\p{L}\p{N}])"))
    hits = holding(whole.select(F.col("doc_id").alias("key"), "text"), small(terms), "key", "text").distinct().withColumn("pattern", pattern)
    sql = _spans("term", "@@", "true").replace(_quoted("@@"), "pattern")
    added = hits.select("key", F.xxhash64("text").alias("h"), F.expr(sql).alias("x"))
    added = added.groupBy("key", "h").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("added"))
    own = [base[c] for c in base.columns]
    joined = base.join(added, base["doc_id"].eqNullSafe(added["key"]) & (F.xxhash64(base["text"]) == added["h"]), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return joined.select(*own, spans.alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span of text generalised to its kind, such as [EMAIL]; overlapping spans to that of the first."""
    cleaned = _replaced("concat('[', upper(s.kind), ']')")
    rows = marked(docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row")), support, threshold)
    return rows.withColumn("text", cleaned).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def find(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, the number of base spans of each kind, base and spans."""
    found = marked(docs.select("doc_id", "text"), support, threshold)

    def is_kind(kind: str) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, "base", "spans")
