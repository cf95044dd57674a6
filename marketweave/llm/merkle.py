"""A Merkle manifest of a dataset, built by higher-order functions over blocks of leaves.

A leaf is the digest of a document's fields. Documents of a source are numbered in order of their
ids, and every BLOCK consecutive leaves are gathered into one array, in which `aggregate` collapses
level after level, each a `transform` over a `sequence` of `slice`s of FAN nodes. As BLOCK is a power of
FAN, the root of a full block is a node of the source's tree: the roots are the leaves of the next
round, until every source is one block. Sources' roots form a tree of their own in the same way.

Paths go the other way: the siblings on the way from a block's root to the root are joined with the
block, one row for BLOCK leaves, and each leaf's own siblings are picked inside of the block's array. No row
holds more than a block, and a source of a third of all rows is as many blocks as it has.

Numbers come from ranges: rows are dealt by ranges of (source, doc_id), written, counted per range and
source, and numbered within these; nothing is ordered in one task.

Defined cases: null fields are `-`; null ids come first; rows that share source and id are ordered by their
leaves, and equal rows are leaves of their own, in any order; a source of one row has that leaf as its
root; an empty table gives an empty result; further columns are neither hashed nor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.llm.common import cut, saved, small

#: Children of a node; levels that are collapsed in one array, and its leaves.
FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
#: Rows of a range, about.
RANGE = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(*values: Column) -> Column:
    """Digest of values, each with its length before it."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return digest(F.concat(*told))


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes (tree, key, leaf, tampered) with `at`, the place in the tree's order of (key, leaf), and `total`, the tree's leaves."""
    ranges = max(1, -(-nodes.count() // RANGE))
    # equal rows are parted by where they stand, so that no key is a range that cannot be split
    placed = saved(nodes.withColumn("tie", F.monotonically_increasing_id()))
    order = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ranged = cut(placed.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    # one row per range and tree: ranges follow each other, so a tree's counts add up to where each begins
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("tree", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    inside = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order[1:])) - 1
    return ranged.withColumn("inside", inside).join(small(begins), ["tree", "range"]).withColumn("at", F.col("begin") + F.col("inside")).drop("begin", "inside", "range", "tie")


def _collapsed(leaves: Column, depth: Column, fan: int) -> Column:
    """All levels of an array of leaves, the leaves first; every run of `fan` nodes becomes its digest, `depth` times."""

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(level) / fan).cast("int") - 1)
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * fan + 1, fan), "")))

    grown = lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1))))
    return F.aggregate(F.sequence(F.lit(1), depth), F.array(leaves), grown)


def _with_levels(blocks: DataFrame, fan: int, levels: int) -> DataFrame:
    """blocks (.., nodes, total) with their levels: to one node if the block is the whole tree, else as many as a full block has."""
    steps = F.array(*[F.lit(fan**k) for k in range(levels)])
    depth = F.when(F.col("total") > fan**levels, levels).otherwise(F.size(F.filter(steps, lambda p: p < F.size("nodes"))))
    leaves = F.transform("nodes", lambda x: x["node"])
    return blocks.withColumn("levels", F.when(depth == 0, F.array(leaves)).otherwise(_collapsed(leaves, F.greatest(depth, F.lit(1)), fan)))


def _siblings(levels: Column, at: Column, fan: int) -> Column:
    """For leaf `at`, the nodes left and right of its own in their run, level by level to the one below the root."""

    def of(level: Column, k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(float(fan)), k)).cast("int")
        first = own - own % fan
        told = lambda there: F.concat(*[F.coalesce(F.when(there(first + i, own), F.get(level, first + i)), F.lit("")) for i in range(fan)])
        return F.struct(told(lambda x, y: x < y).alias("left"), told(lambda x, y: x > y).alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), of)


def _built(ranked: DataFrame, fan: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks (tree, block, total, nodes, levels), lowest first, and the roots (tree, node)."""
    block, rounds, roots, now = fan**levels, [], None, ranked
    while True:
        row = F.struct("at", "node", *[c for c in now.columns if c not in ("tree", "at", "node", "total")])
        gathered = now.groupBy("tree", F.floor(F.col("at") / block).alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(row)).alias("nodes"))
        blocks = saved(_with_levels(gathered, fan, levels))
        rounds.append(blocks)
        whole = blocks.where(F.col("total") <= block).select("tree", F.element_at(F.element_at("levels", -1), 1).alias("node"))
        roots = whole if roots is None else roots.unionByName(whole)
        if blocks.where(F.col("total") > block).isEmpty():
            return rounds, roots
        top = F.element_at(F.element_at("levels", -1), 1).alias("node")
        now = blocks.where(F.col("total") > block).select("tree", F.col("block").alias("at"), top, F.ceil(F.col("total") / block).alias("total"))


def _paths(rounds: list[DataFrame], tops: DataFrame, fan: int, levels: int) -> DataFrame:
    """For each leaf: tree, its row, path (array of left and right); tops (tree, path) leads on from the trees' roots."""
    block, above = fan**levels, None
    for k, blocks in reversed(list(enumerate(rounds))):
        alone = F.col("total") <= block
        led = blocks.where(alone).join(small(tops), "tree")
        if above is not None:
            led = led.unionByName(blocks.where(~alone).join(above, ["tree", "block"]))
        each = F.transform("nodes", lambda x, i: F.struct(x.alias("row"), F.concat(_siblings(F.col("levels"), i, fan), F.col("path")).alias("path")))
        leaves = led.select("tree", F.explode(each).alias("leaf")).select("tree", "leaf.row", "leaf.path")
        above = leaves if k == 0 else cut(leaves.select("tree", F.col("row.at").alias("block"), "path"))
    return above


def _folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def manifest(docs: DataFrame, tampered: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Per document: doc_id, source, leaf, subroot, root, path (siblings left and right, level by level) and folded_root.

    folded_root is recomputed by the path from the leaf, or from the leaf of `tampered`, a text in place of the document's.
    """
    own = leaf(*[F.col(c) for c in FIELDS])
    changed = own if tampered is None else F.when(tampered.eqNullSafe(F.col("text")), None).otherwise(leaf(*[tampered if c == "text" else F.col(c) for c in FIELDS]))
    # null sources first; the texts are read here only
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("tree")
    leaves = saved(docs.select(tree, F.col("doc_id").alias("key"), own.alias("leaf"), changed.alias("tampered")))
    ranked = _numbered(leaves).select("tree", "at", F.col("leaf").alias("node"), "total", "key", "tampered")
    rounds, subroots = _built(ranked, fan, levels)
    subroots = cut(subroots)
    # the tree of sources: one row a source
    one = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("node").alias("leaf"), F.lit(None).cast("string").alias("tampered"))
    upper, root = _built(_numbered(one).select("tree", "at", F.col("leaf").alias("node"), "total", "key"), fan, levels)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    end = root.select("tree", nothing.alias("path"))
    tops = _paths(upper, end, fan, levels).select(F.col("row.key").alias("tree"), F.col("row.node").alias("subroot"), "path")
    tops = cut(tops)
    top = (root.first() or [None, None])[1]  # one digest
    found = _paths(rounds, tops.select("tree", "path"), fan, levels)
    named = found.join(small(tops.select("tree", "subroot")), "tree")
    return named.select(
        F.col("row.key").alias("doc_id"),
        F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30)).alias("source"),
        F.col("row.node").alias("leaf"),
        "subroot",
        F.lit(top).cast("string").alias("root"),
        "path",
        _folded(F.coalesce("row.tampered", "row.node"), F.col("path")).alias("folded_root"),
    )


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))
