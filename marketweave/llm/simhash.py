"""SimHash near-dedup with pigeonhole blocks.

A fingerprint's 64 bits are split into six blocks. Fingerprints that differ in at most three bits
agree on at least three whole blocks, so each is put into one bucket for every choice of three
blocks (20 buckets of about 32 bits each); the members of a bucket are compared by Hamming
distance and the links joined to connected components. Equal fingerprints are one node.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle; repeated shingles
count each time; a null doc_id stands in its group but is never its least id; repeated rows each
return a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm import pairing
from marketweave.llm.common import components, cut, small

BLOCKS, SAME = 6, 3
SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Bits set in over half of the XXH64 values of the text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = words_per_shingle
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    raw = b"".join([digest(flat[s:e], SEED) for s, e in spans])
    n = len(words) - k + 1
    bits = np.zeros(64, dtype=np.int64)
    table = np.frombuffer(raw, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 65_536):
        bits += np.unpackbits(table[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and h, a hash of the text, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words_per_shingle) for x in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": found.view(np.int64), "h": batch.column("h")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, fp long, h long")


def masks() -> list[int]:
    """One mask of kept bits per choice of SAME blocks, as signed longs."""
    edge = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    block = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(BLOCKS)]
    kept = [sum(chosen) for chosen in combinations(block, SAME)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (u, v) that connect the fp values at `distance` or fewer differing bits."""
    if distance > BLOCKS - SAME:
        raise ValueError(f"{BLOCKS} blocks of which {SAME} agree find distances up to {BLOCKS - SAME}")
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks())]))
    rows = distinct.select(keys.alias("bucket"), F.col("fp").alias("id"), F.lit(1).cast("long").alias("weight"))

    def prepare(table: pa.Table) -> dict[str, np.ndarray]:
        return {"fp": table.column("id").to_numpy().view(np.uint64)}

    def near(data: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(data["fp"][a] ^ data["fp"][b]) <= distance

    return pairing.linked(rows, prepare, near).where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).distinct()


def _placed(prints: DataFrame, distance: int) -> DataFrame:
    """Per fp: least, its least doc_id, and root, the same for all fp of a component."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tree = components(links(classes.select("fp"), distance))
    return classes.join(tree, classes["fp"] == tree["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def clusters(docs: DataFrame, words_per_shingle: int = 3, distance: int = 3) -> DataFrame:
    """Per document: doc_id, fp and component_id, the least doc_id of its component."""
    prints = cut(fingerprints(docs, words_per_shingle))
    placed = _placed(prints, distance)
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.drop("h").join(placed.join(lowest, "root").select("fp", "component_id"), "fp")


def representatives(docs: DataFrame, words_per_shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component: of least doc_id, nulls last, then of least hash of the text, then of the whole row."""
    prints = cut(fingerprints(docs, words_per_shingle))
    rows = prints.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "h", "times"))
    kept = cut(rows.join(_placed(prints, distance), "fp").groupBy("root").agg(first.alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.h").alias("__h"), F.col("x.times").alias("__times")))
    match = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h"))
    single = docs.join(kept.where("__times = 1"), match, "left_semi")
    # of rows equal in id and text, one stays
    repeated = docs.join(small(kept.where("__times > 1")), match).groupBy("__id", "__h").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return single.unionByName(repeated.select("row.*"))
