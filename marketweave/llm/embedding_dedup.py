"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one node of a weight. Each node is put into one bucket per table, named by the
signs of its products with that table's hyperplanes. Rows carry BITS further signs to their
buckets: only those that have a partner there at a Hamming distance that a link may have (all but
one link in a billion) go on, and only for them the vectors are fetched. Then the members of a
bucket are compared by cosine in double precision. A link counts in the first table in which its
two ends share a bucket.

The number of signs follows the number of vectors and the number of tables follows the signs, so
that a pair at the threshold is missed with probability MISS at most.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links
with nothing; vectors of different lengths don't link; equal rows link with each other; an id that
stands with different vectors has a row for each, with its own links; a row of null id links with
nothing and has no component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm import pairing
from marketweave.llm.common import components, cut, saved

MISS = 1e-3
#: Signs of the sketch, and standard deviations above the mean distance of a link that it allows.
BITS, ALLOWED = 256, 6.0


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(signs per table, tables) for n vectors."""
    signs = max(8, math.ceil(math.log2(max(2, n))))
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(MISS) / math.log(1 - agree))


def planes(size: int, count: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, count))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def codes(unit: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """The bucket of each row in each table, as an integer of `signs` bits."""
    bits = (unit @ planes(unit.shape[1], signs * tables) >= 0).reshape(len(unit), tables, signs)
    return bits @ (1 << np.arange(signs, dtype=np.int64))


def sketches(unit: np.ndarray) -> np.ndarray:
    """BITS signs of each row, packed."""
    return np.packbits(unit @ planes(unit.shape[1], BITS, seed=12) >= 0, axis=1)


def allowed(threshold: float) -> int:
    """Distance of two sketches up to which a pair at the threshold may be."""
    p = math.acos(threshold) / math.pi
    return math.ceil(BITS * p + ALLOWED * math.sqrt(BITS * p * (1 - p)))


def _by_width(column: pa.ListArray, most: int = 2_000):
    """(rows, matrix) of a list column, by length of the lists and `most` rows at once."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy()
    start = np.cumsum(size) - size
    for width in np.unique(size):
        own = np.flatnonzero(size == width)
        for at in range(0, len(own), most):
            rows = own[at : at + most]
            yield rows, flat[start[rows][:, None] + np.arange(width)]


def links(nodes: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(id, links, root) from nodes (id, weight, embedding): see pairing.linked."""
    signs, tables = plan(nodes.count(), threshold)
    far = allowed(threshold)

    def deal(batches):
        for batch in batches:
            for rows, x in _by_width(batch.column("embedding")):
                unit = unit_rows(x)
                code = codes(unit, signs, tables)
                bits = pa.array([r.tobytes() for r in sketches(unit)], pa.binary())
                ids = batch.column("id").take(pa.array(rows))
                salt = np.int64(x.shape[1]) << 50
                for t in range(tables):
                    yield pa.RecordBatch.from_pydict({"bucket": (salt ^ np.int64(t) << 40) ^ code[:, t], "tab": np.full(len(rows), t, dtype=np.int32), "id": ids, "bits": bits})

    def sketched(table: pa.Table) -> dict[str, np.ndarray]:
        raw = b"".join(table.column("bits").to_pylist())
        return {"bits": np.frombuffer(raw, dtype=np.uint64).reshape(table.num_rows, BITS // 64)}

    def alike(data: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(data["bits"][a] ^ data["bits"][b]).sum(axis=1, dtype=np.int64) <= far

    dealt = nodes.select("id", "embedding").mapInArrow(deal, "bucket long, tab int, id long, bits binary")
    kept = saved(pairing.linking(dealt, sketched, alike).distinct())
    table_of = F.shiftright(F.col("bucket"), 40).bitwiseAND(F.lit(1023)).cast("int")
    rows = kept.select("bucket", "id", table_of.alias("tab")).join(nodes, "id")

    def prepare(table: pa.Table) -> dict[str, np.ndarray]:
        column = pa.chunked_array(table.column("embedding").chunks).combine_chunks()
        size = column.value_lengths().to_numpy()
        unit = np.zeros((len(size), int(size.max())))
        for rows, x in _by_width(column):
            unit[rows, : x.shape[1]] = unit_rows(x)
        return {"unit": unit, "size": size, "tab": table.column("tab").to_numpy()}

    def near(data: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ij->i", data["unit"][a], data["unit"][b]) >= threshold) & (data["size"][a] == data["size"][b])

    def every(data: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (data["unit"][a] @ data["unit"][b].T >= threshold) & (data["size"][a][:, None] == data["size"][b][None, :])

    def first(data: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rows = np.unique(np.concatenate([a, b]))
        code = np.zeros((len(rows), tables), dtype=np.int64)
        for width in np.unique(data["size"][rows]):
            own = np.flatnonzero(data["size"][rows] == width)
            for at in range(0, len(own), 2_000):
                part = own[at : at + 2_000]
                code[part] = codes(data["unit"][rows[part]][:, :width], signs, tables)
        at_a, at_b, tab = np.searchsorted(rows, a), np.searchsorted(rows, b), data["tab"][a]
        out = np.ones(len(a), dtype=bool)
        for t in range(tables):
            open_ = out & (tab > t)
            out[open_] = code[at_a[open_], t] != code[at_b[open_], t]
        return out

    return pairing.linked(rows, prepare, near, first, every)


def clusters(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    data = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    # equal vectors by 128 bits of hash: ids alone are grouped, however many share a vector
    named = data.where(good).select("vec_id", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), F.col("embedding")).alias("k"), "embedding")
    same = named.groupBy("h", "k").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    same = saved(same.withColumn("id", F.monotonically_increasing_id()))
    # one row of each class brings its vector: that of its least id, once
    first = named.join(same, (named["vec_id"] == same["least"]) & (named["h"] == same["h"]) & (named["k"] == same["k"]))
    nodes = saved(first.select("id", "weight", "embedding").dropDuplicates(["id"]))
    found = cut(links(nodes, threshold))
    tree = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    placed = same.join(total, "id", "left").join(tree, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(lowest, "root").select("h", "k", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = named.join(placed, ["h", "k"]).select("vec_id", "n_links", "component_id")
    alone = data.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
