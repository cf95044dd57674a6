"""Winnowing fingerprints of documents, in DataFrame operations only.

Every K consecutive code points are hashed, each gram on its own: column expressions carry no
state from one gram to the next; in every window of W hashes the least is chosen, the
rightmost of equals, and its position kept. Two texts that share any W + K - 1 code points in a row
share a chosen hash. A fingerprint is the list of chosen values, in order of position: each is a
long with the hash in its upper 31 bits and the complement of the position in its lower 32, so that
the least value is the least hash and, among equals, the rightmost.

Defined cases: a null text is empty and has an empty fingerprint; a text of fewer than K code
points is one gram; one of fewer than W grams is one window; equal texts have equal fingerprints;
two empty fingerprints are alike (1.0). The next document is the next in descending order of
(doc_id, text), nulls last, and the first after the last; repeated rows follow one another; an only
document is its own next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.llm.common import text_of

K, W = 12, 16
#: Rows that are ordered together, about; ranges of ids at most, and bytes of a text by which null ids are parted.
IDS, TOPS, LEADING = 256, 256, 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def grams(text: Column, offset: Column, k: int = K) -> Column:
    """One long per gram of the text, whose first code point stands at `offset` in the document."""
    low = F.lit(4294967295)
    name = lambda bytes_, at: F.shiftleft(F.shiftrightunsigned(F.xxhash64(bytes_), 33), 32).bitwiseOR(low - at)

    def of(points: Column) -> Column:
        n = (F.octet_length(points) / 4).cast("int")
        rolled = F.transform(F.sequence(F.lit(0), n - k), lambda i: name(F.substring(points, i * 4 + 1, F.lit(4 * k)), i.cast("long") + offset))
        return F.when(n >= k, rolled).when(n > 0, F.array(name(points, offset.cast("long")))).otherwise(F.array().cast("array<bigint>"))

    return let(F.encode(text, "UTF-32"), of)


def windows(values: Column, w: int = W) -> Column:
    """Least value from each position over w values (fewer at the end), by doubling."""
    if w & (w - 1):
        raise ValueError("the window must be a power of two")

    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda m: F.zip_with(m, F.slice(m, step + 1, F.greatest(F.size(m), F.lit(1))), lambda a, b: F.least(a, b))

    step = 1
    while step < w:
        values = let(values, doubled(step))
        step *= 2
    return values


def chosen(minima: Column, n: Column, w: int = W) -> Column:
    """The distinct minima of the full windows over n values, or of the only one."""
    return F.array_distinct(F.slice(minima, 1, F.greatest(n - (w - 1), F.lit(1))))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """The fingerprint of a text."""
    return let(grams(text, F.lit(0).cast("long"), k), lambda v: chosen(windows(v, w), F.size(v), w))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all hashes of two fingerprints."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: F.shiftright(v, 32)))
    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda p: let(F.size(F.array_intersect(p["a"], p["b"])), lambda both: F.when(F.size(p["a"]) + F.size(p["b"]) == 0, 1.0).otherwise(both / F.greatest(F.size(p["a"]) + F.size(p["b"]) - both, F.lit(1)))))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.hex(v)), ",")


def _pair(text: Column, edited: Column, kept: Column, k: int, w: int) -> Column:
    """Fingerprints of a text and of its edited text, which share the first `kept` code points.

    The windows of grams that lie in the kept part are taken over from the text.
    """

    def of(v: Column) -> Column:
        same = F.greatest(F.when(F.size(v) > 0, kept - (k - 1)).otherwise(0), F.lit(0))  # grams in the kept part
        taken = F.greatest(same - (w - 1), F.lit(0))  # windows of such grams
        tail = grams(F.substring(edited, same + 1, F.char_length(edited)), same.cast("long"), k)
        rest = F.when((same > 0) & (F.char_length(edited) - same < k), F.slice(v, taken + 1, same - taken)).otherwise(F.concat(F.slice(v, taken + 1, same - taken), tail))

        def both(m: Column) -> Column:
            new = let(rest, lambda r: F.slice(windows(r, w), 1, F.greatest(F.size(r) - (w - 1), F.when(taken > 0, 0).otherwise(1))))
            return F.struct(chosen(m, F.size(v), w).alias("own"), F.array_distinct(F.concat(F.slice(m, 1, taken), new)).alias("edited"))

        return let(windows(v, w), both)

    return let(grams(text, F.lit(0).cast("long"), k), of)


def _edit(rows: DataFrame, k: int, w: int) -> DataFrame:
    """rows (.., text, next) with n_chars, edited text and both fingerprints."""
    rows = rows.withColumn("n_chars", F.char_length("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring("next", F.lit(1), third)))
    return rows.withColumn("fp", _pair(F.col("text"), F.col("edited"), F.col("n_chars") - third, k, w))


def _result(rows: DataFrame) -> DataFrame:
    """The result columns from rows with fp and next_fp."""
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp.own")).alias("fingerprint"),
        as_text(F.col("fp.edited")).alias("edited_fingerprint"),
        likeness(F.col("fp.own"), F.col("fp.edited")).alias("near_edited"),
        likeness(F.col("fp.own"), F.col("next_fp")).alias("near_next"),
    )


def _buckets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the bucket (top, low) of each row: higher for higher ids, null ids below all.

    Tops are ranges between quantiles of the ids, cut evenly into as many lows as leave about IDS rows in each,
    whether ids are dense, sparse or clustered. Null ids are parted by the first bytes of their texts.
    """
    n = docs.count()
    tops = min(TOPS, max(1, n // IDS))
    lows = math.ceil(max(1, n) / (tops * IDS))
    # TOPS + 1 numbers, whatever the input
    edges = docs.agg(F.percentile_approx("doc_id", [i / tops for i in range(tops + 1)], 100_000).alias("edges")).first().edges or [0] * (tops + 1)
    own, bounds = F.col("doc_id"), F.array(*[F.lit(e).cast("long") for e in edges])
    top = F.size(F.filter(F.slice(bounds, 2, tops - 1), lambda e: e <= own)) if tops > 1 else F.lit(0)
    # never null, so that no filter sets the shuffle of one reader of the buckets apart from that of the other
    placed = docs.withColumn("top", F.coalesce(F.when(own.isNotNull(), top), F.lit(-1)).cast("int"))
    at = lambda c: F.try_element_at(bounds, c).cast("double")
    first, end = at(F.col("top") + 1), at(F.col("top") + 2)
    even = F.least(F.greatest(F.floor((own.cast("double") - first) / F.greatest(end - first, F.lit(1.0)) * lows), F.lit(0)), F.lit(lows - 1))
    told = F.conv(F.hex(F.rpad(F.substring(F.encode("text", "UTF-8"), 1, LEADING), LEADING, F.lit(b"\0"))), 16, 10).cast("long")
    return placed.withColumn("low", F.coalesce(F.when(F.col("doc_id").isNull(), told).otherwise(even).cast("long"), F.lit(0).cast("long")))


def compare(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    The order over all documents is made of buckets: texts are shuffled once, by bucket. Only the
    last document of a bucket has its next in another one; these few are joined to the first
    documents of the buckets below.
    """
    base = _buckets(docs.select(F.col("doc_id"), text_of().alias("text")))
    order = Window.partitionBy("top", "low").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    placed = base.withColumns({"next": F.lead("text").over(order), "before": F.lag(F.lit(1)).over(order)})
    inner = _edit(placed, k, w).withColumn("next_fp", F.lead("fp.own").over(order)).where("next IS NOT NULL")

    # the bucket below each bucket, the highest below the lowest: tops are TOPS + 1 at most
    heads = base.select("top", "low").distinct()
    tops = heads.groupBy("top").agg(F.max("low").alias("low"))
    over = Window.orderBy(F.col("top").desc())
    follow = lambda c: F.coalesce(F.lead(c).over(over), F.first(c).over(over))
    below = tops.select("top", F.struct(follow("top").alias("top"), follow("low").alias("low")).alias("below"))
    inside = F.lead("low").over(Window.partitionBy("top").orderBy(F.col("low").desc()))
    down = heads.withColumn("inside", inside).join(F.broadcast(below), "top")
    down = down.select("top", "low", F.when(F.col("inside").isNotNull(), F.struct("top", F.col("inside").alias("low"))).otherwise(F.col("below")).alias("at"))
    first = placed.where("before IS NULL").select(F.struct("top", "low").alias("at"), F.col("text").alias("next"))
    last = placed.where("next IS NULL").select("top", "low", "doc_id", "text").join(down, ["top", "low"]).join(first, "at")
    outer = _edit(last, k, w).withColumn("next_fp", fingerprint(F.col("next"), k, w))
    return _result(inner).unionByName(_result(outer))
