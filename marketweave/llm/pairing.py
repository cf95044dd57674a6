"""Verification of candidate pairs that share a bucket, without emitting the pairs.

Rows (bucket, id, weight, payload...) meet in groups. A bucket of over BLOCK rows is dealt into
blocks and each pair of blocks is a group of its own, so no task holds more than two blocks of a
hot bucket. A group answers with one row per linked id: the weight of the ids linked to it, and
the least id reachable inside the group. What is answered is linear in the rows, however dense the
links; what a bucket of n rows compares is all of its pairs, for which n / BLOCK copies of its rows
are sent. `linking` only tells which rows have a link at all: with a payload of a few bytes it
sifts rows whose real payload is large before that is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import small

#: Rows of a block; a group has two at most.
BLOCK = 2_048
#: Rows that are looked at together (groups are kept whole), and rows of a tile of a larger group.
CHUNK, TILE = 8_192, 128
#: Groups up to this size are compared together, neighbours at each distance at once.
LITTLE = 24

Data = dict[str, np.ndarray]
Near = Callable[[Data, np.ndarray, np.ndarray], np.ndarray]


def grouped(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows with columns i, j and side, replicated so that all pairs of a bucket meet in a group (bucket, i, j)."""
    hot = rows.groupBy("bucket").agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    hot = hot.select("bucket", F.ceil(F.col("__n") / block).cast("int").alias("__g"))
    dealt = rows.join(small(hot), "bucket", "left").withColumn("__b", F.when(F.col("__g").isNotNull(), F.pmod(F.xxhash64("id"), F.col("__g")).cast("int")).otherwise(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__g"), F.lit(1)) - 1)).alias("__o")
    paired = dealt.select("*", other)
    return paired.select(*rows.columns, F.least("__b", "__o").alias("i"), F.greatest("__b", "__o").alias("j"), F.col("__b").alias("side"))


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            next_ = root[root]
            if (next_ == root).all():
                break
            root = next_
        if (root == before).all():
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _table(near: Near) -> Callable[[Data, np.ndarray, np.ndarray], np.ndarray]:
    """near over all pairs of two index arrays, as a matrix."""
    return lambda data, left, right: near(data, np.repeat(left, len(right)), np.tile(right, len(left))).reshape(len(left), len(right))


def _pairs(keys: list[np.ndarray], side: np.ndarray, data: Data, near: Near, table: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of links, in parts of bounded size; rows are sorted by the keys bucket, i and j."""
    starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    sizes = np.diff(np.append(starts, len(side)))
    group = np.repeat(np.arange(len(starts)), sizes)
    little = (sizes <= LITTLE)[group] & (sizes > 1)[group]
    for d in range(1, min(LITTLE, int(sizes.max()))):
        a = np.flatnonzero(little[:-d] & (group[:-d] == group[d:]))
        b = a + d
        across = (keys[1][a] == keys[2][a]) | (side[a] != side[b])
        a, b = a[across], b[across]
        yes = near(data, a, b)
        yield a[yes], b[yes]
    for g in np.flatnonzero(sizes > LITTLE):
        at = np.arange(starts[g], starts[g] + sizes[g])
        own = keys[1][at[0]] == keys[2][at[0]]
        left = at if own else at[side[at] == keys[1][at[0]]]
        right = at if own else at[side[at] == keys[2][at[0]]]
        for lo in range(0, len(left), TILE):
            rows = left[lo : lo + TILE]
            columns = right[lo:] if own else right
            yes = table(data, rows, columns)
            if own:
                yes &= rows[:, None] < columns[None, :]
            a, b = np.nonzero(yes)
            yield rows[a], columns[b]


def _in_groups(rows: DataFrame, settle: Callable[[pa.Table], pa.RecordBatch | None], schema: str, block: int, partitions: int | None) -> DataFrame:
    """settle over whole groups, about CHUNK rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = 0

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows_held
            table = pa.Table.from_batches(held).combine_chunks()
            end = table.num_rows
            if not last:
                key = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
                change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
                end = int(change[-1]) + 1 if len(change) else 0
            if end and (out := settle(table.slice(0, end))) is not None:
                yield out
            rest = table.slice(end)
            held = rest.to_batches() if rest.num_rows else []
            rows_held = rest.num_rows

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(at, CHUNK))
                rows_held += held[-1].num_rows
                if rows_held >= CHUNK:
                    yield from whole(False)
        if rows_held:
            yield from whole(True)

    ready = grouped(rows, block)
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = ready.repartition(count, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ready.mapInArrow(run, schema)


def linking(rows: DataFrame, prepare: Callable[[pa.Table], Data], near: Near, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """(bucket, id), perhaps repeated, of the rows that have a link in their bucket."""

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        data = prepare(table)
        some = np.zeros(table.num_rows, dtype=bool)
        for a, b in _pairs([table.column(c).to_numpy() for c in ("bucket", "i", "j")], table.column("side").to_numpy(), data, near, _table(near)):
            some[a] = some[b] = True
        return pa.RecordBatch.from_pydict({c: table.column(c).to_numpy()[some] for c in ("bucket", "id")}) if some.any() else None

    return _in_groups(rows, settle, "bucket long, id long", block, partitions)


def linked(
    rows: DataFrame,
    prepare: Callable[[pa.Table], Data],
    near: Near,
    counted: Near | None = None,
    table: Callable[[Data, np.ndarray, np.ndarray], np.ndarray] | None = None,
    block: int = BLOCK,
    partitions: int | None = None,
) -> DataFrame:
    """(id, links, root) of the ids that have a link in some group.

    prepare makes arrays from a chunk's columns; near tells which of the index pairs are links, and table the same
    for all pairs of two index arrays; counted tells which of the found links this bucket counts (another bucket may
    hold them too).
    """
    every = table or _table(near)

    def settle(chunk: pa.Table) -> pa.RecordBatch | None:
        ids, weight = chunk.column("id").to_numpy(), chunk.column("weight").to_numpy()
        data = prepare(chunk)
        # an id may stand in several groups of a chunk; names are its first row
        name, node = np.unique(ids, return_inverse=True)
        links = np.zeros(len(name), dtype=np.int64)
        touched = np.zeros(len(name), dtype=bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        edges = 0

        def joined() -> list[tuple[np.ndarray, np.ndarray]]:
            # a star for each component says as much as all of its edges
            root = roots_of(len(name), *(np.concatenate(x) for x in zip(*held, strict=True)))
            inner = np.flatnonzero(root != np.arange(len(name)))
            return [(inner, root[inner])]

        for a, b in _pairs([chunk.column(c).to_numpy() for c in ("bucket", "i", "j")], chunk.column("side").to_numpy(), data, near, every):
            if not len(a):
                continue
            some = counted(data, a, b) if counted else slice(None)
            u, v = node[a], node[b]
            np.add.at(links, u[some], weight[b][some])
            np.add.at(links, v[some], weight[a][some])
            touched[u] = touched[v] = True
            held.append((u, v))
            edges += len(u)
            if edges > 1_000_000:
                held = joined()
                edges = len(held[0][0])
        if not held:
            return None
        root = roots_of(len(name), *(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_pydict({"id": name[touched], "links": links[touched], "root": name[root[touched]]})

    return _in_groups(rows, settle, "id long, links long, root long", block, partitions)
